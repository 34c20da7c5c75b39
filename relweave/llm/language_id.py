"""Language identification by the nearest centroid.

A text becomes a vector of its letters' byte n-grams, weighted by the logarithm
of their count and by their rarity over the sample (TF-IDF), of length 1. Every
language has several centroids, clusters of its sample's vectors; the language
of the centroid with the greatest cosine is predicted. A text that stands
farther from it than nearly all sample texts of that language do is rejected.

The model is fitted on a bounded sample. Languages cluster apart from each
other, one group of a sample's texts in a task each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.llm.common import col, kept, pieces, staged

#: Documents of each language from which the model is fitted, about and on average at most; languages at most.
SAMPLE_PER_LANGUAGE, MAX_LANGUAGES = 2_000, 1_000
#: n-grams are 2 to 4 bytes long and fall into 2^BITS places.
SIZES, BITS = (2, 3, 4), 15
#: Centroids of a language and rounds of clustering.
CLUSTERS, ROUNDS = 4, 8
#: Of a language's sample texts, those farthest away set the distance beyond which a text is rejected.
REJECTED_SHARE = 0.005
#: A language of fewer sample texts has them all both in its centroids and in the calibration.
FEW = 25
UNKNOWN = "und"

_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text's n-grams, ascending, and how often each occurs. Words keep a blank on either side; what is no letter separates."""
    words = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "
    code = np.frombuffer(words, dtype=np.uint8).astype(np.uint32)
    counts = np.zeros(1 << BITS, dtype=np.int64)
    whole = code
    for n in range(2, max(SIZES) + 1):
        whole = (whole[:-1] << np.uint32(8)) | code[n - 1 :]
        if n in SIZES and len(whole):
            counts += np.bincount(((whole + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    """languages: of each centroid. centroids: one a column. nearest: least cosine of each language that isn't rejected."""

    rarity: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    least: dict[str, float]
    sharpness: float = 20.0

    def __post_init__(self):
        self.names = sorted(set(self.languages))
        self.of = [[i for i, x in enumerate(self.languages) if x == n] for n in self.names]

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, counts = grams(text)
        weight = (1 + np.log(counts)) * self.rarity[at]
        length = math.sqrt(float((weight * weight).sum()))
        return at, (weight / length if length else weight).astype(np.float32)

    def cosines(self, text: str) -> np.ndarray:
        """Of each language, in the order of names: the greatest cosine to one of its centroids."""
        at, weight = self.vector(text)
        near = weight @ self.centroids[at]
        return np.array([near[k].max() for k in self.of], dtype=np.float64)

    def score(self, cosines: np.ndarray) -> float:
        """Share of the nearest language when every one weighs as the exponential of its cosine."""
        return float(1 / np.exp(self.sharpness * (cosines - cosines.max())).sum())


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _sample(docs: DataFrame, text: str, lang: str, held_out: Column, per_language: int) -> DataFrame:
    """lang, body (text), part (0 to 4) and few, of about per_language documents of each language, equal texts once.

    A text is in by its hash, at a rate set by the language's count, so any copy
    of it is; copies combine before the shuffle. Languages' counts come to the
    driver, MAX_LANGUAGES at most.
    """
    known = docs.select(col(lang).cast("string").alias("lang"), col(text).alias("body"), held_out.alias("held")).filter("lang IS NOT NULL AND NOT held").filter(has_letter(F.col("body")))
    counts = known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return known.select("lang", "body", F.lit(0).alias("part"), F.lit(True).alias("few")).limit(0)
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], per_language / r["count"])])
    number = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], r["count"])])
    drawn = F.pmod(F.xxhash64("body"), F.lit(1 << 32)) < F.element_at(rate, F.col("lang")) * (1 << 32)
    picked = known.filter(drawn).groupBy("lang", "body").agg(F.lit(1).alias("one"))
    return staged(picked.select("lang", "body", F.pmod(F.xxhash64("body", F.lit(1)), F.lit(5)).cast("int").alias("part"), (F.element_at(number, F.col("lang")) < FEW).alias("few")), "sample")


def _rarity(sample: DataFrame) -> np.ndarray:
    """Of every place the logarithm of one over the share of texts that have it. Tasks add up before they send."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, texts = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for t in batch.column("body").to_pylist():
                counts[grams(t)[0]] += 1
                texts += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], texts))], ["place", "n"])

    found = {r["place"]: r["n"] for r in sample.select("body").mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()}
    texts, out = found.pop(-1, 0), np.zeros(1 << BITS)
    for place, n in found.items():
        out[place] = n
    return np.log((1 + texts) / (1 + out)) + 0.1


def cluster(vectors: list[tuple[np.ndarray, np.ndarray]], clusters: int = CLUSTERS, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means of sparse vectors of length 1, one centroid a row, started from the first ones; a centroid that no vector is nearest to stays."""
    centroids = np.zeros((min(clusters, len(vectors)), 1 << BITS), dtype=np.float32)
    for k, (at, weight) in enumerate(vectors[: len(centroids)]):
        centroids[k, at] = weight
    for _ in range(rounds):
        sums, columns = np.zeros_like(centroids, dtype=np.float64), np.ascontiguousarray(centroids.T)
        for at, weight in vectors:
            sums[int((weight @ columns[at]).argmax()), at] += weight
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        moved = np.where(length > 0, sums / np.where(length > 0, length, 1), centroids).astype(np.float32)
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    return centroids


def fit(docs: DataFrame, held_out: Column, text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fits on a sample of the documents that have a language and a letter and aren't held out.

    Four fifths of it make the centroids; the rest sets how sharply cosines tell
    languages apart and beyond which distance a text is rejected. Without such
    documents the model has no language and everything is unknown.
    """
    sample = _sample(docs, text, lang, held_out, per_language)
    fitted, rest = sample.filter("few OR part < 4"), sample.filter("few OR part = 4")
    bare = Model(_rarity(fitted), [], np.zeros((1 << BITS, 0), np.float32), {})

    def centres(rows: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(rows["body"])  # one order on every run
        found = cluster([bare.vector(t) for t in texts])
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centroid": [c.tobytes() for c in found]})

    rows = sorted(fitted.select("lang", "body").groupBy("lang").applyInPandas(centres, "lang string, centroid binary").collect())
    if not rows:
        return bare
    model = Model(bare.rarity, [r["lang"] for r in rows], np.ascontiguousarray(np.array([np.frombuffer(r["centroid"], dtype=np.float32) for r in rows]).T), {})
    seen = [(r["lang"], np.array(r["cosines"])) for r in scored(rest, model, "body", ["lang"]).select("lang", "cosines").collect()]
    own = {n: sorted(c[i] for name, c in seen if name == n) for i, n in enumerate(model.names)}
    model.least = {n: float(x[int(REJECTED_SHARE * len(x))]) if x else -1.0 for n, x in own.items()}
    right = [(c, model.names.index(n)) for n, c in seen if n in model.names]

    def loss(sharpness: float) -> float:
        return -sum(sharpness * (c[i] - c.max()) - math.log(np.exp(sharpness * (c - c.max())).sum()) for c, i in right)

    model.sharpness = min((5.0, 10.0, 20.0, 40.0, 80.0, 160.0), key=loss)
    return model


def scored(docs: DataFrame, model: Model, text: str, keep: list[str], reject: bool = False) -> DataFrame:
    """keep, and for each text: lang_pred, score (0 to 1), rejected (boolean), cosines (of the model's languages, by name).

    One row per input row and no shuffle; equal texts score alike, an empty table
    gives an empty one, a tie goes to the language first by name. A null text,
    one without a letter, and any text under a model of no language are unknown
    ("und", score 0, no cosines, not rejected). With reject a rejected text is
    unknown too. Columns of keep with a made name are replaced.
    """
    made = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType()), T.StructField("cosines", T.ArrayType(T.DoubleType()))])
    fields = [f for f in docs.select(*[col(c) for c in keep]).schema.fields if f.name.lower() not in made.names]
    source = docs.select(*kept(fields), has_letter(col(text)).alias("lettered"), col(text).cast("binary").alias("body"))

    def one(text: bytes | None, letters: bool) -> tuple[str, float, bool, list[float] | None]:
        if not letters or not model.names:
            return UNKNOWN, 0.0, False, None
        cosines = model.cosines(text.decode("utf-8", "replace"))
        best = int(cosines.argmax())
        far = bool(cosines[best] < model.least.get(model.names[best], -1.0))
        return UNKNOWN if far and reject else model.names[best], model.score(cosines), far, cosines.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "body"):
            rows = [one(t, x) for t, x in zip(part.column("body").to_pylist(), part.column("lettered").to_pylist(), strict=True)]
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.string(), pa.float64(), pa.bool_(), pa.list_(pa.float64())), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(fields)], *columns], [*(f.name for f in fields), *made.names])

    return source.mapInArrow(run, T.StructType([*fields, *made.fields]))
