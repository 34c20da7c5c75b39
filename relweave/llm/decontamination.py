"""Benchmark decontamination with a distributed positional inverted index.

The index is of the training documents and knows nothing of any benchmark, so
one index serves many. Documents are laid end to end in segments of about
SEGMENT terms, with a free place between neighbours; a posting list holds the
places of one term in one segment. Segments are made where their documents are
read, so storing all postings shuffles nothing.

1. The frequency of every benchmark term is summed over its posting lists.
2. Of every window of an item the two rarest terms are its probes; a window with
   a term that no document has can't occur.
3. The probes' postings, less their offset in the item, meet at the place where
   the item would begin: two probes at one place make a candidate.
4. There all terms of the item are asked for: their posting lists are cut down
   to the wanted places; runs of a window's length are exact matches.

Proximity: an item is near a document where its rarest terms stand within a
span of places, in whatever order.

Terms are compared by a 64-bit hash of their bytes. What is asked of the index
is staged first, so that Spark knows its size when it chooses how to join it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.llm.common import pieces, row_key, staged
from relweave.llm.shingles import word_hashes
from relweave.llm.terms import _TABLE, terms

WINDOW = 10
PROBES = 2
#: Terms of a segment, about: a document is never split, and the last segment of a task is smaller.
SEGMENT = 1 << 17
#: Proximity asks for so many of an item's rarest terms (all, if it has fewer) within so many places.
NEAR_TERMS, NEAR_SPAN = 5, 16
#: Places of a stretch of a segment, in which places are matched with documents.
STRETCH = 1 << 10


@dataclass
class Index:
    """documents: doc_id, key, n_words, segment, first (its first place). lists: segment, term, n, at (ascending places)."""

    documents: DataFrame
    lists: DataFrame


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms in order, and the first term of each text (one more at the end)."""
    words, firsts = word_hashes([t.translate(_TABLE) for t in texts])
    return words.view(np.int64), firsts


def build(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> Index:
    """Stores the index of docs. A null text has no terms. Rows of one id and text are indexed each."""
    source = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text).alias("key"), F.col(text).cast("binary").alias("body"))
    schema = f"segment bigint, doc_id {source.schema['doc_id'].dataType.simpleString()}, key binary, n_words bigint, first int, term bigint, n int, at array<int>"
    names = ["segment", "doc_id", "key", "n_words", "first", "term", "n", "at"]

    def rows(segment: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        made = {"segment": pa.array(np.full(size, segment))} | columns
        return pa.RecordBatch.from_arrays([made[c] if c in made else pa.nulls(size, kinds[c]) for c in names], schema=pa.schema([(c, kinds[c]) for c in names]))

    kinds = {"segment": pa.int64(), "doc_id": pa.null(), "key": pa.binary(), "n_words": pa.int64(), "first": pa.int32(), "term": pa.int64(), "n": pa.int32(), "at": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId() << 32
        held: list[np.ndarray] = []
        places: list[np.ndarray] = []
        begin = 0

        def lists() -> Iterator[pa.RecordBatch]:
            words, at = np.concatenate(held), np.concatenate(places)
            if not len(words):
                return
            order = np.argsort(words, kind="stable")
            words, at = words[order], at[order]
            edges = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1], [True]])).astype(np.int32)
            yield rows(segment, {"term": pa.array(words[edges[:-1]]), "n": pa.array(np.diff(edges)), "at": pa.ListArray.from_arrays(pa.array(edges), pa.array(at))})

        for part in pieces(batches, "body"):
            kinds["doc_id"] = part.column("doc_id").type
            words, firsts = _hashed([b or b"" for b in part.column("body").to_pylist()])
            counts = np.diff(firsts)
            start = 0
            while start < len(counts):
                # As many documents as fit, one at least.
                ends = begin + np.cumsum(counts[start:] + 1)
                fits = max(int(np.searchsorted(ends, SEGMENT, side="right")), 0 if begin else 1)
                if fits:
                    stop = start + fits
                    first = begin + np.concatenate([[0], np.cumsum(counts[start:stop] + 1)[:-1]])
                    columns = {"doc_id": part.column("doc_id")[start:stop], "key": part.column("key")[start:stop], "n_words": pa.array(counts[start:stop]), "first": pa.array(first.astype(np.int32))}
                    yield rows(segment, columns)
                    own = counts[start:stop]
                    held.append(words[firsts[start] : firsts[stop]])
                    places.append((np.repeat(first - (firsts[start:stop] - firsts[start]), own) + np.arange(own.sum())).astype(np.int32))
                    begin, start = int(ends[fits - 1]), stop
                if start < len(counts):
                    yield from lists()
                    segment, begin = segment + 1, 0
                    held, places = [], []
        if held:
            yield from lists()

    stored = staged(source.mapInArrow(run, schema), "index")
    return Index(stored.filter("term IS NULL").select("doc_id", "key", "n_words", "segment", "first"), stored.filter("term IS NOT NULL").select("segment", "term", "n", "at"))


def entries(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id (string), entry (one for equal term lists), words (term hashes), n. Items without a term are left out."""
    source = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "body"):
            bodies = [b or b"" for b in part.column("body").to_pylist()]
            words, firsts = _hashed(bodies)
            lists = pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array(words))
            joined = pa.array([b" ".join(terms(b)) for b in bodies], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("item_id"), joined, lists, pa.array(np.diff(firsts).astype(np.int32))], ["item_id", "joined", "words", "n"])

    out = source.mapInArrow(run, "item_id string, joined binary, words array<bigint>, n int").filter("n > 0")
    return out.select("item_id", F.unhex(F.sha2("joined", 256)).alias("entry"), "words", "n")


def frequencies(index: Index, words: DataFrame) -> DataFrame:
    """term, freq: how often each of the words' terms occurs. Terms without an occurrence are left out."""
    return index.lists.select("term", "n").join(words.select("term"), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("freq"))


def probes(words: DataFrame, freq: DataFrame, window: int, count: int = PROBES) -> DataFrame:
    """entry, off, term, least: the rarest terms of every window that may occur; least: how many of them a match has.

    words: entry, off, term, n.
    """
    per = words.join(freq, "term", "left").groupBy("entry", "n").agg(F.sort_array(F.collect_list(F.struct("off", F.coalesce("freq", F.lit(0)).alias("freq"), "term"))).alias("w"))
    size = F.least(F.lit(window), F.col("n"))
    starts = F.sequence(F.lit(0), F.col("n") - size)
    windows = F.filter(F.transform(starts, lambda i: F.slice("w", i + 1, size)), lambda v: F.forall(v, lambda x: x["freq"] > 0))
    rarest = F.transform(windows, lambda v: F.slice(F.sort_array(F.transform(v, lambda x: F.struct(x["freq"], x["off"], x["term"]))), 1, count))
    return per.select("entry", F.least(F.lit(count), F.col("n")).alias("least"), F.explode(F.array_distinct(F.flatten(rarest))).alias("x")).select("entry", "least", "x.off", "x.term")


def _postings(index: Index, wanted: DataFrame) -> DataFrame:
    """segment, place and the columns of `wanted`, for each posting of its terms."""
    return index.lists.join(wanted, "term").select("segment", *wanted.columns, F.explode("at").alias("place"))


def candidates(index: Index, rare: DataFrame) -> DataFrame:
    """segment, entry, place (of the item's first term) at which as many different probes meet as any match has."""
    # A place of a document has one term, so an offset meets a beginning once at most.
    begun = _postings(index, rare).withColumn("place", F.col("place") - F.col("off"))
    return begun.groupBy("segment", "entry", "place").agg(F.count("*").alias("met"), F.max("least").alias("least")).filter("met >= least").select("segment", "entry", "place")


def in_documents(index: Index, found: DataFrame) -> DataFrame:
    """found(segment, place, ...) with the key and the first place of the document that has the place. Places between documents go."""
    stretch = lambda c: F.floor(c / STRETCH)
    # A document stands in every stretch that it touches, so a place meets the documents of its stretch only.
    docs = index.documents.filter("n_words > 0").select("segment", "key", "first", "n_words", F.explode(F.sequence(stretch(F.col("first")), stretch(F.col("first") + F.col("n_words") - 1))).alias("stretch"))
    return found.withColumn("stretch", stretch(F.col("place"))).join(docs, ["segment", "stretch"]).filter("place >= first AND place < first + n_words").drop("stretch", "n_words")


def proximity(index: Index, words: DataFrame, freq: DataFrame, count: int = NEAR_TERMS, span: int = NEAR_SPAN) -> DataFrame:
    """key, entry: the documents in which the entry's `count` rarest terms (all, if it has fewer different ones) stand within `span` places.

    A term counts once however often the entry has it; of equally frequent terms
    the one that comes first in the entry is the rarer. An entry with a term
    that no document has among them is near nothing.
    """
    one = words.groupBy("entry", "term").agg(F.min("off").alias("off")).join(freq, "term", "left")
    ranked = one.groupBy("entry").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "off", "term"))), 1, count).alias("w")).filter(F.get("w", F.lit(0))["freq"] > 0)
    rare = staged(ranked.select("entry", F.size("w").alias("least"), F.explode("w.term").alias("term")), "rarest")
    # Any range of `span` places lies in one of two neighbouring bands, each two spans long.
    banded = _postings(index, rare).withColumn("band", F.explode(F.array(F.floor(F.col("place") / span), F.floor(F.col("place") / span) - 1)))
    # A band of 2 * span places holds no more postings than places.
    grouped = banded.groupBy("segment", "entry", "band").agg(F.collect_set(F.struct("place", "term")).alias("s"), F.max("least").alias("least")).filter(F.size(F.array_distinct("s.term")) >= F.col("least"))
    within = lambda x: F.filter("s", lambda y: (y["place"] >= x["place"]) & (y["place"] < x["place"] + span))
    begun = grouped.select("segment", "entry", "least", F.explode(F.transform("s", lambda x: F.struct(x["place"].alias("place"), within(x).alias("v")))).alias("b")).filter(F.size(F.array_distinct("b.v.term")) >= F.col("least"))
    placed = in_documents(index, begun.select("segment", "entry", "least", F.col("b.place").alias("place"), F.col("b.v").alias("v")))
    # Those that stand in the next document don't count.
    ends = placed.join(index.documents.select("segment", "key", "first", "n_words"), ["segment", "key", "first"])
    own = F.filter("v", lambda y: y["place"] < F.col("first") + F.col("n_words"))
    return ends.filter(F.size(F.array_distinct(F.transform(own, lambda y: y["term"]))) >= F.col("least")).select("key", "entry").distinct()


@dataclass
class Query:
    """A benchmark asked of an index: its items, their words, and the words' frequencies."""

    listed: DataFrame
    words: DataFrame
    freq: DataFrame


def ask(index: Index, items: DataFrame) -> Query:
    listed = staged(entries(items), "items")
    words = staged(listed.select("entry", "n", F.posexplode("words").alias("off", "term")).distinct(), "words")
    return Query(listed, words, staged(frequencies(index, words), "frequencies"))


def phrases(index: Index, query: Query, window: int = WINDOW) -> DataFrame:
    """The exact matches as (key, entry, item_id, first, end).

    A match is a run of document words [first, end) that is a window of the item:
    `window` consecutive item words, or the whole of a shorter item. Nulls, empty
    texts and texts without words have no matches. Rows of the same id and text
    share a key, and the matches with it.
    """
    rare = staged(probes(query.words, query.freq, window), "probes")
    places = staged(candidates(index, rare), "places")
    asked = places.join(query.words, "entry").select("segment", "entry", "place", "n", "off", "term", (F.col("place") + F.col("off")).alias("at"))
    # Each posting list is cut down to what is wanted of it before anything is unnested.
    lists = index.lists.join(query.words.select("term"), "term", "left_semi").select("segment", "term", F.col("at").alias("all"))
    cut = asked.groupBy("segment", "term").agg(F.collect_set("at").alias("some")).join(lists, ["segment", "term"])
    there = cut.select("segment", "term", F.explode(F.array_intersect("some", "all")).alias("at"))
    met = asked.join(there, ["segment", "term", "at"]).groupBy("segment", "entry", "place").agg(F.sort_array(F.collect_set("off")).alias("offs"), F.max("n").alias("n"))
    size = F.least(F.lit(window), F.col("n"))
    begun = met.select("segment", "entry", size.alias("size"), F.col("place").alias("origin"), F.explode(F.filter("offs", lambda o, i: F.get("offs", i + size - 1) == o + size - 1)).alias("off"))
    found = begun.select("segment", "entry", "size", (F.col("origin") + F.col("off")).alias("place")).distinct()
    inside = in_documents(index, found).select("key", "entry", (F.col("place") - F.col("first")).alias("begin"), "size").distinct()
    matches = inside.select("key", "entry", F.col("begin").alias("first"), (F.col("begin") + F.col("size")).alias("end"))
    return matches.join(query.listed.select("entry", "item_id").distinct(), "entry")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row of docs: doc_id, key, n_words, n_hit (words inside a match), items (sorted item ids with a match), spans (merged hit ranges of words), near (sorted item ids near the document).

    A null text counts as an empty one. Repeated rows have equal results, and
    items of equal words are named each. Other columns of docs are not read.
    """
    index = build(docs, id_col, text)
    query = ask(index, items)
    per = phrases(index, query, window).groupBy("key").agg(F.sort_array(F.collect_set(F.struct("first", "end"))).alias("m"), F.sort_array(F.collect_set("item_id")).alias("items"))
    empty = F.expr("cast(array() AS array<struct<first:int,end:int>>)")

    def merged(done, x):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["first"].alias("first"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= x["first"]), joined).otherwise(F.concat(done, F.array(F.struct(x["first"].alias("first"), x["end"].alias("end")))))

    per = per.select("key", "items", F.aggregate("m", empty, merged).alias("spans"))
    near = proximity(index, query.words, query.freq).join(query.listed.select("entry", "item_id").distinct(), "entry").groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("near"))
    length = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["first"])
    out = index.documents.join(per.join(near, "key", "full"), "key", "left")
    none = F.expr("cast(array() AS array<string>)")
    return out.select("doc_id", "key", "n_words", F.coalesce(length, F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("spans", empty).alias("spans"), F.coalesce("near", none).alias("near"))
