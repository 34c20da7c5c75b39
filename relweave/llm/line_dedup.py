"""Line hashing: passages that occur before, in the same or a lower-ranked document, go.

Two kinds of passages get a digest of their terms, so case, punctuation and
spacing don't count. Their borders depend on nearby text only:

- from every sentence or line, the fewest whole sentences (over line ends, if
  need be) that have MIN_WORDS terms: short ones count with what follows them;
- from every border among the terms, the text up to the first border MIN_PIECE
  terms on. Borders are the least hashes of two terms in every SPAN places, so
  that sentence and line ends play no part: any RUN terms that come before, in
  another sentence, hold a passage that goes.

Of all passages with one digest the earliest stays. Rank is the id (an integer
by its value, anything else by a hash of it, null last), then a hash of the
text, then the place in the text. Inside a single sentence nothing is held
against the sentence itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.llm.common import col, kept, pieces
from relweave.llm.terms import _TABLE

#: Shorter repeats, a fixed phrase or a short sentence, are left alone.
MIN_WORDS = 20
#: RUN terms have RUN - 1 pairs: the first border in a run is one of the first SPAN, the last one of the last SPAN, so MIN_PIECE <= RUN - 2 * SPAN.
RUN, SPAN, MIN_PIECE = 50, 18, 14
_SENTENCE = re.compile(rb"[^.!?]*[.!?]+[ \t]*|[^.!?]+")
_LAST = 2**63 - 1
#: Stands among a document's removed digests if it repeats a passage of its own.
_OWN = bytes(16)


def _borders(words: list[bytes]) -> np.ndarray:
    """Indexes of the terms before which a border lies: the last least pair of every SPAN consecutive ones."""
    h = np.array(list(map(crc32, words)), np.uint64)
    h = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    last = np.lib.stride_tricks.sliding_window_view(h, SPAN)[:, ::-1].argmin(axis=1)
    chosen = np.zeros(len(h), bool)
    chosen[np.arange(len(last)) + SPAN - 1 - last] = True
    return np.flatnonzero(chosen)


def _passages(text: bytes, min_words: int = MIN_WORDS) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, bytes, int]]]:
    """Sentences (line number, first byte, end byte), which tile the lines, and passages (sentence, first byte, end byte, digest, terms), by sentence."""
    from xxhash import xxh3_128_digest as digest

    plain = text.translate(_TABLE)
    words = plain.split()
    edges = np.flatnonzero(np.diff(np.concatenate(([0], np.frombuffer(plain, np.uint8) != 32, [0]))))
    starts, ends = edges[::2], edges[1::2]
    joined = b" ".join(words)
    place = np.concatenate(([0], np.cumsum(ends - starts + 1)))  # of each term in `joined`
    at_word = place.tolist()
    sentences, at = [], 0
    for number, line in enumerate(text.split(b"\n")):
        sentences += [(number, at + m.start(), at + m.end()) for m in _SENTENCE.finditer(line)] or [(number, at, at)]
        at += len(line) + 1
    upto = np.searchsorted(starts, [b for _, _, b in sentences]).tolist()
    found, first, j = [], 0, 0
    for i, (_, a, _) in enumerate(sentences):
        if upto[i] > first:
            while j < len(upto) and upto[j] < first + min_words:
                j += 1
            if j == len(upto):
                break
            found.append((i, a, sentences[j][2], digest(joined[at_word[first] : at_word[upto[j]] - 1]), upto[j] - first))
        first = upto[i]
    if len(words) >= RUN:
        borders = _borders(words)
        till = np.searchsorted(borders, borders + MIN_PIECE)
        borders, till = borders[till < len(borders)], borders[till[till < len(borders)]]
        of = np.searchsorted(upto, borders, side="right").tolist()
        for i, p, q, a, last, b in zip(of, borders.tolist(), till.tolist(), starts[borders].tolist(), ends[till - 1].tolist(), starts[till].tolist(), strict=True):
            stop = text.find(b"\n", last, b)
            found.append((i, a, b if stop < 0 else stop, digest(joined[at_word[p] : at_word[q] - 1]), q - p))
        found.sort(key=lambda f: f[:2])
    return sentences, found


def _count(text: bytes) -> int:
    """Number of a text's sentences, as _passages has them."""
    return sum(len(_SENTENCE.findall(line)) or 1 for line in text.split(b"\n"))


def units(text: bytes) -> Iterator[tuple[int, int, int, bytes | None, int | None]]:
    """Line number, first byte, end byte, digest and number of terms of the passage that begins there, in order.

    A sentence has None for both if none begins with it. A further passage that
    begins in a sentence comes before it, without a byte of its own.
    """
    sentences, found = _passages(text)
    k = 0
    for i, (number, a, b) in enumerate(sentences):
        own = (None, None)
        while k < len(found) and found[k][0] == i:
            _, start, _, digest, n = found[k]
            if start == a and own == (None, None):
                own = (digest, n)
            else:
                yield number, start, start, digest, n
            k += 1
        yield number, a, b, *own


def _digests(docs: DataFrame, min_words: int) -> DataFrame:
    """One row (doc, print, hi, lo) per document and different digest, and one of _OWN for a document that repeats one in another sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "body"):
            at, found = [], []
            for i, body in enumerate(part.column("body").to_pylist()):
                seen: dict[bytes, int] = {}
                own = False
                for sentence, _, _, digest, _ in _passages(body, min_words)[1]:
                    own |= seen.setdefault(digest, sentence) != sentence
                if own:
                    seen[_OWN] = 0
                at += [i] * len(seen)
                found += seen
            at, halves = pa.array(at, pa.int64()), np.frombuffer(b"".join(found), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([part.column("doc").take(at), part.column("print").take(at), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], ["doc", "print", "hi", "lo"])

    return docs.mapInArrow(run, "doc bigint, print bigint, hi bigint, lo bigint")


def rebuild(text: bytes, gone: frozenset[bytes], min_words: int = MIN_WORDS) -> tuple[bytes, int, list[dict]]:
    """The text without passages whose digest is in `gone` or came in an earlier sentence; its sentences; the removed byte spans.

    Spans are in order and don't touch; the text without them is the result. A
    line of which only white space would be left goes whole, with its line end.
    """
    sentences, found = _passages(text, min_words)
    seen: dict[bytes, int] = {}
    spans: list[list[int]] = []

    def remove(a: int, b: int) -> None:
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])

    for i, a, b, digest, _ in found:
        if seen.setdefault(digest, i) != i or digest in gone:
            remove(a, b)
    if not spans:
        return text, len(sentences), []
    cut, spans, at, k = spans, [], 0, 0
    for line in text.split(b"\n"):
        end, left, place = at + len(line), b"", at
        own = []
        while k < len(cut) and cut[k][0] < max(end, at + 1):
            a, b = max(cut[k][0], at), min(cut[k][1], end)
            own.append((a, b))
            left += text[place:a]
            place = b
            if cut[k][1] > end:
                break
            k += 1
        if own and not (left + text[place:end]).strip():
            own = [(at, min(end + 1, len(text)))]
        for a, b in own:
            if b > a:
                remove(a, b)
        at = end + 1
    kept = b"".join(text[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(text)], strict=True))
    return kept, len(sentences), [{"start": a, "end": b} for a, b in spans]


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the text rewritten, and n_units (sentences), n_removed (spans) and removed (array of start, end).

    One row per input row; removed holds byte offsets into the original text in
    UTF-8, and the text without them is the new one. A null text stays null,
    with no units; an empty table gives an empty one. Rows of one id and text
    are one document and have one result; rows that share an id, but not a text,
    are ranked by a hash of it, as are those without an id. Columns named like the
    new ones are replaced, others kept whatever their names.

    Digests are counted with map-side aggregation, so a line in a third of all
    documents costs no task more than any other; the join that tells documents
    of their repeated units is a plain equi-join, whose hot keys Spark splits.
    """
    new = ("n_units", "n_removed", "removed")
    fields = [f for f in docs.schema.fields if f.name.lower() not in new]
    at = [f.name for f in fields].index(text)
    whole = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    rank = F.coalesce(col(id_col).cast("bigint") if whole else F.when(col(id_col).isNotNull(), F.xxhash64(col(id_col))), F.lit(_LAST))
    # The text's hash stands beside the rank, so that rows without an id, or of one id, aren't gathered in one group.
    keyed = [rank.alias("doc"), F.xxhash64(col(text)).alias("print"), col(text).cast("binary").alias("body")]
    texts = docs.filter(col(text).isNotNull()).select(*keyed)
    found = _digests(texts.select("doc", "print", "body"), min_words)
    digest = F.unhex(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in ("hi", "lo"))))
    shared = texts.groupBy("doc").agg((F.min("print") < F.max("print")).alias("several")).filter("several")
    if shared.isEmpty():
        # An id has one text, so the id alone ranks, and sums of two longs combine before the shuffle.
        own, first, last = F.col("doc"), F.min("doc"), F.max("doc")
    else:
        own = F.struct("doc", "print")
        first, last = F.min(own), F.max(own)
    first = found.groupBy("hi", "lo").agg(first.alias("first"), last.alias("last")).filter("first < last OR hi = 0 AND lo = 0").drop("last")
    gone = found.join(first, ["hi", "lo"]).filter((own > F.col("first")) | F.expr("hi = 0 AND lo = 0")).groupBy("doc", "print").agg(F.collect_set(digest).alias("gone"))
    others = len(fields) - 1
    joined = docs.select(*[c for i, c in enumerate(kept(fields)) if i != at], *keyed).join(gone, ["doc", "print"], "left").drop("doc", "print")
    schema = T.StructType([T.StructField(f.name, T.StringType()) if i == at else f for i, f in enumerate(fields)])
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    for name, kind in zip(new, (T.LongType(), T.LongType(), spans), strict=True):
        schema = schema.add(name, kind)
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "body"):
            bodies, lists = part.column("body").to_pylist(), part.column("gone").to_pylist()
            # Most texts lose nothing, and needn't be cut into passages again.
            made = [(None, 0, []) if b is None else rebuild(b, frozenset(g), min_words) if g else (b, _count(b), []) for b, g in zip(bodies, lists, strict=True)]
            columns = part.columns[:others]
            columns.insert(at, pa.array([t for t, _, _ in made], pa.binary()).cast(pa.string()))
            columns += [pa.array([n for _, n, _ in made], pa.int64()), pa.array([len(s) for _, _, s in made], pa.int64()), pa.array([s for _, _, s in made], spans_type)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return joined.mapInArrow(run, schema)
