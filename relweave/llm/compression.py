"""Compression classifier.

Two zstandard dictionaries are made, one of blocks of good and one of blocks of
bad labelled text. A text is compressed with each, block by block, so that the
dictionaries weigh as much at its end as at its start. The difference of the
two sizes over their sum is all that is known of a text; a logistic curve over
it, fitted on labelled texts that made neither dictionary, gives the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.llm.calibration import fit_logistic, sigmoid
from relweave.llm.common import fresh, pieces
from relweave.llm.labelled import class_sizes, training_sample

#: Labelled documents of each class from which the model is fitted, at most.
SAMPLE_PER_CLASS = 3_000
#: Bytes of a block; blocks of each class that train a dictionary, at most.
BLOCK, BLOCKS_PER_CLASS = 1024, 4_000
DICTIONARY_BYTES, SEGMENT, DMER, LEVEL = 131_072, 64, 8, 3


@dataclass
class Model:
    bad: bytes
    good: bytes
    weight: float
    intercept: float

    def __post_init__(self):
        self.compressors = None

    def __getstate__(self):
        return (self.bad, self.good, self.weight, self.intercept)

    def __setstate__(self, state):
        self.bad, self.good, self.weight, self.intercept = state
        self.compressors = None

    def difference(self, text: bytes) -> float:
        """Size by the bad dictionary less size by the good one, over their sum: above 0 for what is nearer to good text."""
        if self.compressors is None:
            import zstandard as zs

            dictionaries = [zs.ZstdCompressionDict(x) for x in (self.bad, self.good)]
            for d in dictionaries:
                d.precompute_compress(level=LEVEL)
            self.compressors = [zs.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) for d in dictionaries]
        bad, good = self.compressors
        by_bad = by_good = 0
        for start in range(0, max(1, len(text)), BLOCK):
            block = text[start : start + BLOCK]
            by_bad += len(bad.compress(block))
            by_good += len(good.compress(block))
        return (by_bad - by_good) / (by_bad + by_good)

    def score(self, difference: float) -> float:
        return sigmoid(self.weight * difference + self.intercept)


def _dictionary(blocks: DataFrame, label: int) -> bytes:
    """A trained dictionary; the blocks themselves where the library finds too little in them to train on."""
    import zstandard as zs

    # At most BLOCKS_PER_CLASS blocks come to the driver, 4 MB.
    picked = [bytes(r["block"]) for r in blocks.filter(F.col("label") == label).orderBy(F.xxhash64("block"), "block").limit(BLOCKS_PER_CLASS).collect()]
    try:
        return zs.train_dictionary(min(DICTIONARY_BYTES, max(256, sum(map(len, picked)) // 4)), picked, k=SEGMENT, d=DMER).as_bytes()
    except zs.ZstdError:
        return b"".join(picked)


def fit(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fits on at most per_class labelled documents of each class outside the held-out fold.

    Half of them, by a hash of the text, train the dictionaries; the other half
    the curve, whose intercept is then set to the class shares of all labels.
    Without both classes in both halves every text scores the share of class 1.
    """
    n0, n1 = class_sizes(labels, label, held_out)
    share = math.log((n1 + 0.5) / (n0 + 0.5))
    sample = training_sample(docs, labels, label, held_out, per_class).withColumn("half", F.pmod(F.xxhash64("body", F.lit(1)), F.lit(2)))
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.length("body") - 1) / BLOCK), F.lit(0)).cast("int"))
    blocks = sample.filter("half = 0").select("label", F.explode(F.transform(starts, lambda i: F.substring("body", i * BLOCK + 1, F.lit(BLOCK)))).alias("block"))
    model = Model(_dictionary(blocks, 0), _dictionary(blocks, 1), 0.0, share)
    seen = scored(sample.filter("half = 1"), model, "body", ["label"]).select("label", "difference").toPandas()
    y = seen["label"].to_numpy(dtype=float)
    if 0 < y.sum() < len(y) and model.bad and model.good:
        # The prior on the weight is weak: there is one weight, and thousands of rows.
        weight, intercept = fit_logistic(seen[["difference"]].to_numpy(dtype=float), y)
        model.weight, model.intercept = float(weight), float(intercept + share - math.log(y.sum() / (len(y) - y.sum())))
    return model


def scored(docs: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    """keep, and for each text: score (0 to 1) and difference (double).

    One row per input row and no shuffle. A null text scores as an empty one,
    equal texts score alike, an empty table gives an empty one.
    """
    body = fresh(docs, "body")
    source = docs.select(*[F.col(c) for c in keep], F.col(text).cast("binary").alias(body))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), "score double, difference double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, body):
            found = [model.difference(b or b"") for b in part.column(body).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([model.score(x) for x in found], pa.float64()), pa.array(found, pa.float64())], [*keep, "score", "difference"])

    return source.mapInArrow(run, schema)
