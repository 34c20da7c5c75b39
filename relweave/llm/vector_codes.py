"""Product codes of vectors, searched with the exponion rule.

Components become integers, vectors are cut into equal parts, and every part
position has a codebook of entries. A part's nearest entry is looked for from
the entry that the part had before, at distance r: an entry that is as near or
nearer stands at most 2r from that one, so the entry's neighbours, sorted by
distance, are scanned up to 2r and no further. Distances are squared integers
and ties go to the lower index, so the result is that of comparing with all.

Each round writes vectors with their entries to the shared folder, for the next
round to start from. What comes to the driver, and goes to tasks, is codebooks
and sums of them: entries times dimension, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.llm.common import col, staged

#: Greatest integer component; up to it sums of squares over 8,192 components are exact in 64 bits.
LARGEST = 1 << 24
TOO_LARGE = f"a scaled component is beyond {LARGEST}: sums of squares wouldn't be exact"
#: Candidate components that a search holds at once.
HELD = 1 << 21


@dataclass
class Codebook:
    """Entries of one part position, as integers, one a row, and of each entry all by distance from it."""

    entries: np.ndarray

    def __post_init__(self):
        apart = np.array([((self.entries - e) ** 2).sum(axis=1) for e in self.entries]).reshape(len(self.entries), len(self.entries))
        self.near = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.near, axis=1)

    def search(self, parts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entries, their squared distances, and how many entries were compared."""
        step = max(1, HELD // max(1, self.entries.size))
        found = [self._search(parts[i : i + step], start[i : i + step]) for i in range(0, len(parts), step)]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), sum(f[2] for f in found)

    def _search(self, parts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        radius = ((parts - self.entries[start]) ** 2).sum(axis=1)
        # Twice the distance is four times its square. An entry stands at no distance from itself, so each count is 1 at least.
        inside = (self.apart[start] <= 4 * radius[:, None]).sum(axis=1)
        first = np.concatenate([[0], np.cumsum(inside)[:-1]])
        row = np.repeat(np.arange(len(parts)), inside)
        entry = self.near[start[row], np.arange(len(row)) - first[row]]
        distance = ((parts[row] - self.entries[entry]) ** 2).sum(axis=1)
        least = np.minimum.reduceat(distance, first)
        return np.minimum.reduceat(np.where(distance == least[row], entry, len(self.entries)), first), least, len(row)


def _usable(vector: Column) -> Column:
    """Neither null nor with a component that is null or not finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _integers(lists: pa.ListArray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """All components, floored after scaling, one after the other, and the vectors' lengths."""
    lengths = np.diff(lists.offsets.to_numpy())
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if flat.size and np.abs(flat).max() > LARGEST:
        raise ArithmeticError(TOO_LARGE)
    return flat.astype(np.int64), lengths


def _assign(batch: pa.RecordBatch, books: list[Codebook], dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of vectors that have the books' dimension: which these are, their entries by part, and errors."""
    held = np.array([len(v) == 4 * dimension for v in batch.column("v").to_pylist()], dtype=bool)
    kept = batch.filter(pa.array(held))
    values = np.frombuffer(b"".join(kept.column("v").to_pylist()), dtype="<i4").astype(np.int64).reshape(kept.num_rows, len(books), dimension // len(books))
    before = np.frombuffer(b"".join(kept.column("codes").to_pylist()), dtype=np.uint8).astype(np.int64).reshape(kept.num_rows, len(books))
    codes, errors = np.zeros((kept.num_rows, len(books)), np.int64), np.zeros(kept.num_rows, np.int64)
    for k, book in enumerate(books):
        codes[:, k], distance, _ = book.search(values[:, k], before[:, k])
        errors += distance
    return held, codes, errors


def _round(rows: DataFrame, books: list[Codebook], dimension: int) -> DataFrame:
    """rows with the entries that are nearest now, and error; both null where a vector has another dimension than the books."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, codes, errors = _assign(batch, books, dimension)
            new, error = np.full(batch.num_rows, None, dtype=object), np.full(batch.num_rows, None, dtype=object)
            new[held] = [c.tobytes() for c in codes.astype(np.uint8)]
            error[held] = errors.tolist()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("v"), pa.array(new, pa.binary()), pa.array(error, pa.int64())], ["vec_id", "label", "v", "codes", "error"])

    kinds = dict(rows.dtypes)
    return rows.select("vec_id", "label", "v", "codes").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, v binary, codes binary, error bigint")


def _means(rows: DataFrame, books: list[Codebook], dimension: int) -> list[Codebook]:
    """Each entry moved to the floored mean of the parts that have it; one that none has stays. Tasks add up before they send."""
    entries, width = len(books[0].entries), dimension // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((len(books), entries), np.int64), np.zeros((len(books), entries, width), np.int64)
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, len(books))
            values = np.frombuffer(b"".join(batch.column("v").to_pylist()), dtype="<i4").astype(np.int64).reshape(batch.num_rows, len(books), width)
            for k in range(len(books)):
                counts[k] += np.bincount(codes[:, k], minlength=entries)
                np.add.at(sums[k], codes[:, k], values[:, k])
        book, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(book, width)), pa.array(np.repeat(entry, width)), pa.array(np.tile(np.arange(width), len(book))), pa.array(np.repeat(counts[book, entry], width)), pa.array(sums[book, entry].reshape(-1))], ["book", "entry", "place", "n", "total"])

    added = rows.filter("codes IS NOT NULL").select("v", "codes").mapInArrow(run, "book bigint, entry bigint, place bigint, n bigint, total bigint")
    moved = [b.entries.copy() for b in books]
    for r in added.groupBy("book", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        moved[r["book"]][r["entry"], r["place"]] = r["total"] // r["n"]
    return [Codebook(m) for m in moved]


def encode(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """Rows vec_id, label, code (two hex digits a part), error (squared distance, over parts), label_error (over equal labels, nulls together), and the final codebooks.

    Vectors that are null or hold a null, NaN or infinity are left out; all other
    rows get a row, repeated ids too. Codebooks begin with the vectors of the
    least ids (a null id comes last, equal ids go by their vectors). The first
    of these sets the dimension, which the parts must divide (else ValueError);
    a vector of another dimension has null code and error. Fewer vectors than
    entries make fewer entries; an empty table gives no rows and no codebooks.
    A scaled component beyond 2^24 raises ArithmeticError, since nothing exact could be said of it.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have two hex digits: 1 to 256 entries")
    rows = vectors.select(col(id_col).alias("vec_id"), col(label).alias("label"), col(vector).alias("v")).filter(_usable(F.col("v")))
    seeds = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    dimension = len(seeds[0]["v"]) if seeds else 0
    if dimension % parts:
        raise ValueError(f"{dimension} components can't be cut into {parts} equal parts")
    first = [[int(x) for x in np.floor(np.array(s["v"], dtype=np.float64) * scale)] for s in seeds if len(s["v"]) == dimension]
    whole = np.array(first, dtype=np.int64).reshape(len(first), parts, dimension // parts)
    if not np.abs(whole).max(initial=0) <= LARGEST:
        raise ArithmeticError(TOO_LARGE)
    books = [Codebook(whole[:, k]) for k in range(parts)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, lengths = _integers(batch.column("v"), scale)
            raw, ends = flat.astype("<i4").tobytes(), np.cumsum(lengths) * 4
            packed = [raw[b - 4 * n : b] for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            # No entry came before the first round: it starts from the first one.
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(packed, pa.binary()), pa.array([bytes(parts)] * batch.num_rows, pa.binary())], ["vec_id", "label", "v", "codes"])

    kinds = dict(rows.dtypes)
    now = rows.mapInArrow(pack, f"vec_id {kinds['vec_id']}, label {kinds['label']}, v binary, codes binary")
    if not first:
        return now.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error")), []
    for _ in range(rounds):
        now = staged(_round(now, books, dimension), "codes")
        books = _means(now, books, dimension)
    last = staged(_round(now, books, dimension).select("vec_id", "label", F.lower(F.hex("codes")).alias("code"), "error"), "codes")
    sums = last.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    out = last.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    return out, [b.entries for b in books]


def digest(codebooks: list[np.ndarray]) -> str:
    """sha256 of all components as decimals, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in codebooks for x in book.reshape(-1).tolist()).encode()).hexdigest()
