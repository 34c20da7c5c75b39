"""CSV files cut into byte ranges that many tasks read, though fields may hold line ends.

A line end inside a quoted field ends no record, and whether a range begins
inside one depends on the quotes before it: on their number, which is a count
per range and a running sum over the ranges of a file. A task then puts together
the records that begin in its range; the record that goes on past its end is
met by the pieces that the next ranges have of it.

Quotes inside a field have to be doubled, as `files.write_csv` does and RFC 4180
says: a single quote inside a field without quotes would count for a border.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relweave.sources.staging import staged

#: Ranges beginning inside a record that are sent to every task (about 200 bytes each); more of them meet their lines by a shuffle.
SENT_RANGES = 50_000
WHOLE, BEGUN, GOING, ENDED = range(4)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, block (first byte of the range), at (ascending inside a range) of all lines."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def ranges(rows: DataFrame) -> DataFrame:
    """file, block, inside: whether the range begins inside a quoted field. One row a range, whose sums run along each file."""
    quotes = F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    before = F.sum("quotes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return rows.groupBy("file", "block").agg(quotes.alias("quotes")).select("file", "block", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("inside"))


def _pieces(batches: Iterator[pa.RecordBatch], few: bool) -> Iterator[pa.RecordBatch]:
    """Either the few pieces of records that leave their range, with a file's first record, or all other records. Lines come in order, those of a range together."""
    at, seq, odd, held, kind = None, 0, 0, [], WHOLE

    def batch(seqs, piece: int, texts) -> pa.RecordBatch:
        n = len(texts)
        columns = [pa.repeat(pa.scalar(at[0], pa.string()), n), pa.repeat(pa.scalar(at[1], pa.int64()), n), pa.array(seqs, pa.int64()), pa.repeat(pa.scalar(piece, pa.int32()), n), texts]
        return pa.RecordBatch.from_arrays(columns, ["file", "block", "seq", "piece", "text"])

    def left() -> Iterator[pa.RecordBatch]:
        if held and few:
            yield batch([seq], kind, pa.array(["\n".join(held)], pa.string()))

    for part in batches:
        files, blocks, insides, values = (part.column(c) for c in ("file", "block", "inside", "value"))
        n = part.num_rows
        turns = pc.count_substring(values, '"').to_numpy() & 1
        other = pc.or_(pc.not_equal(files.slice(1), files.slice(0, n - 1)), pc.not_equal(blocks.slice(1), blocks.slice(0, n - 1))) if n > 1 else []
        borders = [0, *(np.flatnonzero(np.asarray(other)) + 1).tolist(), n] if n else []
        for low, high in pairwise(borders):
            here = (files[low].as_py(), blocks[low].as_py())
            if here != at:
                yield from left()
                inside = insides[low].as_py()
                at, seq, odd, held, kind = here, 0, int(inside), [], GOING if inside else BEGUN
            run = values.slice(low, high - low)
            parity = (np.cumsum(turns[low:high]) + odd) & 1
            odd = int(parity[-1])
            ends = np.flatnonzero(parity == 0) + 1
            if not len(ends):
                held += run.to_pylist()
                continue
            # The first record may have begun in earlier batches or ranges; the others are whole.
            first = "\n".join([*held, *run.slice(0, ends[0]).to_pylist()]).removesuffix("\r")
            if first or kind == GOING:
                if few == (kind == GOING or (at[1] == 0 and seq == 0)):
                    yield batch([seq], ENDED if kind == GOING else WHOLE, pa.array([first], pa.string()))
                seq += 1
            size = int(ends[-1] - ends[0])
            if size:
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), run.slice(ends[0], size)), "\n")
                returns = pc.ends_with(texts, "\r")
                if pc.any(returns).as_py():
                    texts = pc.if_else(returns, pc.utf8_slice_codeunits(texts, 0, -1), texts)
                texts = texts.filter(pc.not_equal(texts, ""))
                head = 1 if at[1] == 0 and seq == 0 and len(texts) else 0
                shown = texts.slice(0, head) if few else texts.slice(head)
                if len(shown):
                    yield batch(np.arange(len(shown)) + (seq if few else seq + head), WHOLE, shown)
                seq += len(texts)
            held, kind = run.slice(ends[-1]).to_pylist(), BEGUN
    yield from left()


def records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """file, block, seq and record of a file or folder: first the few records that files begin with or that cross the border of a range, staged, then all others.

    A record stands where it begins, and (block, seq) goes up along a file, from (0, 0). Blank lines are none.
    """
    rows = lines(spark, path)
    state = staged(ranges(rows), "ranges").filter("inside")
    if state.count() <= SENT_RANGES:
        marked = rows.join(F.broadcast(state), ["file", "block"], "left")
    else:
        marked = rows.join(state, ["file", "block"], "left").repartition("file", "block").sortWithinPartitions("file", "block", "at")
    marked = marked.select("file", "block", "value", F.coalesce("inside", F.lit(False)).alias("inside"))
    pieces = lambda few: marked.mapInArrow(partial(_pieces, few=few), "file string, block bigint, seq bigint, piece int, text string")
    cut = staged(pieces(True), "pieces")  # three a range at most
    begun = F.sum((F.col("piece") == BEGUN).cast("int")).over(Window.partitionBy("file").orderBy("block", "seq"))
    joined = cut.filter(F.col("piece") != WHOLE).withColumn("of", begun).groupBy("file", "of").agg(F.sort_array(F.collect_list(F.struct("block", "seq", "text"))).alias("p"))
    met = joined.select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["seq"].alias("seq"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("record"))
    whole = lambda df: df.filter(F.col("piece") == WHOLE).select("file", "block", "seq", F.col("text").alias("record"))
    return whole(cut).unionByName(met), whole(pieces(False))
