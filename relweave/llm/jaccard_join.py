"""N-gram Jaccard self-join by vertical partitioning.

A document is the set of its 5-word shingles, hashed to 64 bits. Documents with
equal sets form a class; only classes are compared.

Room for a partner. Two sets with a Jaccard similarity of 3/4 or more share at
least ceil(3n/4) elements of either, and in whatever order f = 1 + n // SLACK of
the first n - ceil(3n/4) + f elements of both, n being the smaller one's size. By
the hashes' own order, which needs no counting, a class whose prefix has too few
elements that another prefix has drops out; the whole sets of the others are
then asked the same. Tasks add up what they have of an element before it is
shuffled, so an element that all documents have costs a row a task and batch.

Order. The elements that the remaining sets share stand in the order of their
document frequency, rarest first. It is cut into fragments: ranges of frequency
that grow twofold, each cut again by hash. Every set lies in pieces, one a fragment.

Candidates. A set keeps its rarest shared elements, as many as a partner can't
all miss. Fragment by fragment the sets that meet in lists of kept elements are
counted, pairs that a fragment shows to be impossible are struck out, and the
counts are summed per pair. First every list sends its members to one leader
only, which joins groups of copies into components at a cost linear in the
lists; then members of different components are counted with each other, so no
link between components is missed.

Overlaps. A candidate pair's pieces are intersected fragment by fragment, and
the partial overlaps summed per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.llm.common import pieces, row_key, staged
from relweave.llm.components import components
from relweave.llm.shingles import shingle_sets

#: Ranges of frequency (2 and 3, 4 to 7, ..., 256 and more), and parts by hash of each.
GRADES, CUTS = 8, 4
#: A prefix is longer than it must be by the SLACK-th part of the set, and so demands as many shared elements more.
SLACK = 8
#: Elements that a task adds up before it sends them on.
COMBINED = 1 << 20
#: Rounds in which lists send their members to a leader, each with leaders drawn anew.
LEADER_ROUNDS = 2
#: Members of a list that meet in one task; a longer list is cut into blocks that meet each other.
BLOCK = 1_000


def needed(n):
    """Shared elements of a pair whose larger set has n: ceil(3n/4) at least."""
    return (3 * n + 3) // 4


def slack(n):
    return 1 + n // SLACK


def prefix_length(n: int) -> int:
    return n - needed(n) + slack(n)


def _signature(elements: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(elements.tobytes()) - (1 << 63)


def _sets(batches: Iterator[pa.RecordBatch], body: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches, and the sets of their texts."""
    for part in pieces(batches, body):
        yield part, list(shingle_sets([t or b"" for t in part.column(body).to_pylist()]))


def _lists(arrays: list) -> pa.Array:
    """int64 lists from numpy arrays."""
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).astype(np.int64, copy=False), pa.int64()))


def describe(docs: DataFrame, id_col: str, text: str, key: Column | None = None) -> DataFrame:
    """doc_id, key if one is given, sig (null for an empty set), n."""
    names = ["doc_id"] if key is None else ["doc_id", "key"]
    source = docs.select(F.col(id_col).alias("doc_id"), *([] if key is None else [key.alias("key")]), F.col(text).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, "body"):
            sigs = [_signature(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(sigs, pa.int64()), pa.array([len(s) for s in sets], pa.int64())], [*names, "sig", "n"])

    return source.mapInArrow(run, ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in names) + ", sig bigint, n bigint")


def _combined(sets: Iterator[tuple[int, np.ndarray]], limit: int) -> Iterator[pa.RecordBatch]:
    """(h, sig, w) rows of (sig, elements), added up in batches of about `limit` elements.

    w = 0: of this batch only sig has h. w = -1: several have it, and were told
    so. w > 0: sig was told of w - 1 shared elements; h stands for nothing.
    """

    def flush() -> pa.RecordBatch:
        sigs = np.array(list(held))
        h, s = np.concatenate(list(held.values())), np.repeat(sigs, [len(x) for x in held.values()])
        order = np.argsort(h, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0, [True]]))
        several = np.diff(edges) > 1
        told = np.repeat(several, np.diff(edges))
        credited, counts = np.unique(np.concatenate([s[order[told]], sigs]), return_counts=True)
        # Set by set, as they came: rows of one sig side by side take less room in a shuffle.
        w = np.ones(len(h), np.int64)
        w[order[edges[:-1]]] = -several.astype(np.int64)
        sent = np.flatnonzero(w < 1)
        columns = (np.concatenate([h[sent], credited]), np.concatenate([s[sent], credited]), np.concatenate([w[sent], counts]))
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2].astype(np.int32))], ["h", "sig", "w"])

    held: dict[int, np.ndarray] = {}
    size = 0
    for sig, found in sets:
        if sig not in held:
            held[sig] = found
            size += len(found)
        if size >= limit:
            yield flush()
            held, size = {}, 0
    if held:
        yield flush()


def _shared_counts(rows: DataFrame) -> DataFrame:
    """sig, c: how many of its elements other sigs have too, from rows (h, sig, w).

    Streams over sorted partitions and holds one row of an unfinished list. A
    set that came in several batches was told the same in each, so the sum over
    them is divided by their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(np.zeros(0, np.int64) for _ in range(4))  # h, sig, whether several have it, rows that wait to be told
        for batch in batches:
            h, s, w = (batch.column(c).to_numpy().astype(np.int64, copy=False) for c in ("h", "sig", "w"))
            told = w > 0
            out_s, out_c, out_n = [s[told]], [w[told] - 1], [np.ones(told.sum(), np.int64)]
            h, s, several, waiting = (np.concatenate(x) for x in zip(held, (h[~told], s[~told], -w[~told], 1 + w[~told]), strict=True))
            if len(h):
                edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                sizes = np.diff(np.append(edges, len(h)))
                shared = (np.minimum.reduceat(s, edges) != np.maximum.reduceat(s, edges)) | (np.maximum.reduceat(several, edges) > 0)
                hit = np.repeat(shared, sizes) & (waiting > 0)
                out_s.append(s[hit])
                out_c.append(waiting[hit])
                out_n.append(np.zeros(hit.sum(), np.int64))
                last = edges[-1]
                held = (h[last : last + 1], s[last : last + 1], shared[-1:].astype(np.int64), np.zeros(1, np.int64) if shared[-1] else waiting[last:].sum(keepdims=True))
            s, c, n = (np.concatenate(x) for x in (out_s, out_c, out_n))
            sigs, at = np.unique(s, return_inverse=True)
            sums = [np.bincount(at, weights=x, minlength=len(sigs)).astype(np.int64) for x in (c, n)]
            yield pa.RecordBatch.from_arrays([pa.array(sigs), *map(pa.array, sums)], ["sig", "c", "n"])

    dealt = rows.repartition("h").sortWithinPartitions("h")
    counts = dealt.mapInArrow(run, "sig bigint, c bigint, n bigint").groupBy("sig").agg(F.sum("c").alias("c"), F.sum("n").alias("times"))
    return counts.select("sig", F.expr("c DIV times").alias("c"))


def prefix_rows(docs: DataFrame, text: str) -> DataFrame:
    """(h, sig, w) of the prefixes. A task's batch has each class once, so a group of copies costs its elements a batch, not a copy."""
    source = docs.select(F.col(text).cast("binary").alias("body"))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for _, sets in _sets(batches, "body"):
            for s in sets:
                if len(s):
                    yield _signature(s), s[: prefix_length(len(s))]

    limit = COMBINED
    return source.mapInArrow(lambda batches: _combined(prefixes(batches), limit), "h bigint, sig bigint, w int")


def whole_rows(sets: DataFrame) -> DataFrame:
    """(h, sig, w) of sets(sig, elements)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for batch in batches:
            values, offsets = batch.column("elements").values.to_numpy(), batch.column("elements").offsets.to_numpy()
            for i, sig in enumerate(batch.column("sig").to_pylist()):
                yield sig, values[offsets[i] : offsets[i + 1]]

    limit = COMBINED
    return sets.select("sig", "elements").mapInArrow(lambda batches: _combined(each(batches), limit), "h bigint, sig bigint, w int")


def survivors(classes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """classes whose prefixes leave room for a partner: it has ceil(3n/4) elements at least, so shares slack(ceil(3n/4))."""
    return classes.join(_shared_counts(prefixes), "sig").filter(f"c >= 1 + floor(floor((3 * n + 3) / 4) / {SLACK})").drop("c")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text: str) -> DataFrame:
    """(sig, n, elements): the sets of the wanted classes, each once. The wanted ids grow with the corpus, so they are never broadcast."""
    ids = wanted.select(F.col("doc_id").alias("_id")).distinct().hint("merge")
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("binary").alias("body")).join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, "body"):
            if some := [s for s in sets if len(s)]:
                yield pa.RecordBatch.from_arrays([pa.array([_signature(s) for s in some], pa.int64()), pa.array([len(s) for s in some], pa.int64()), _lists(some)], ["sig", "n", "elements"])

    found = chosen.mapInArrow(run, "sig bigint, n bigint, elements array<bigint>")
    # An id may come with other texts than the wanted one, and a text several times.
    return found.join(wanted.select("sig").hint("merge"), "sig", "left_semi").dropDuplicates(["sig"])


def fragments(sets: DataFrame) -> DataFrame:
    """sig, n, c, left, weight, frag, part, keep, rank: the shared elements of the sets that may have partners, cut into fragments.

    c: shared elements, which bounds the overlap with any other set. A partner
    stands in ceil(3n/4) of a set's lists or more, so has no fewer elements than
    the ceil(3n/4)-th smallest of the lists' least members; by that size the two
    must share `left` + 1 elements at least, and sets with fewer drop out. keep:
    the elements of part that are among the c - left rarest of the set; rank: how
    many rarer ones it has. weight: the mean length of the set's lists, which is greatest for the set in the
    middle of a group of near copies.
    """
    rows = sets.select(F.explode("elements").alias("h"), "sig", "n")
    stats = rows.groupBy("h").agg(F.count("*").cast("int").alias("df"), F.min("n").cast("int").alias("least")).filter("df > 1")
    # A list in a third of all sets is a hot key of this join, which Spark splits.
    per = rows.join(stats, "h").groupBy("sig").agg(F.max("n").alias("n"), F.collect_list(F.struct("df", "least", "h")).alias("e"))
    per = per.select("sig", "n", F.col("e.df").alias("df"), F.col("e.least").alias("least"), F.col("e.h").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column("h").offsets.to_numpy()
            df, least, h = (batch.column(c).values.to_numpy() for c in ("df", "least", "h"))
            heads, parts, keeps, ranks = [], [], [], []
            for i, (sig, n) in enumerate(zip(batch.column("sig").to_pylist(), batch.column("n").to_pylist(), strict=True)):
                a, b = offsets[i], offsets[i + 1]
                c, fewest = int(b - a), needed(n)
                if c < fewest:
                    continue
                partner = int(np.partition(least[a:b], fewest - 1)[fewest - 1])
                need = max(fewest, (3 * (n + partner) + 6) // 7)
                if c < need:
                    continue
                order = np.lexsort((h[a:b], df[a:b]))
                own, often = h[a:b][order], df[a:b][order]
                grade = np.minimum(np.log2(often).astype(np.int64), GRADES) - 1
                frag = grade * CUTS + (own >> 61 & CUTS - 1)
                rank = np.arange(c)
                kept = rank < c - need + 1
                weight = int(often.sum()) * 16 // n
                for f in np.unique(frag):
                    at = frag == f
                    heads.append((sig, n, c, need - 1, weight, int(f)))
                    parts.append(own[at])
                    keeps.append(own[at & kept])
                    ranks.append(rank[at & kept])
            if heads:
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in zip(*heads, strict=True)), _lists(parts), _lists(keeps), _lists(ranks)], names)

    names = ["sig", "n", "c", "left", "weight", "frag", "part", "keep", "rank"]
    return per.mapInArrow(run, "sig bigint, n bigint, c bigint, left bigint, weight bigint, frag bigint, part array<bigint>, keep array<bigint>, rank array<bigint>")


def overlaps(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """x, y, overlap for pairs (x, y): partial overlaps of every fragment, summed per pair."""
    side = lambda k, p: cut.select(F.col("sig").alias(k), "frag", F.col("part").alias(p))
    both = pairs.select("x", "y").join(side("y", "q"), "y").join(side("x", "p"), ["x", "frag"])
    return both.select("x", "y", F.size(F.array_intersect("p", "q")).alias("partial")).groupBy("x", "y").agg(F.sum("partial").alias("overlap"))


def _links(pairs: DataFrame, cut: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: the pairs whose Jaccard similarity is 3/4 or more. Pairs are staged, so that Spark knows how many they are."""
    size = lambda k: classes.select(F.col("sig").alias(k), F.col("n").alias(f"n_{k}"))
    found = overlaps(staged(pairs, "pairs"), cut).join(size("x"), "x").join(size("y"), "y")
    return found.filter("100 * overlap >= 75 * (n_x + n_y - overlap)").select(F.col("x").alias("a"), F.col("y").alias("b"))


def _lists_of(cut: DataFrame, labels: DataFrame) -> DataFrame:
    """h, rank, frag, sig, n, c, left, weight, component: a row per kept element."""
    rows = cut.filter(F.size("keep") > 0).select("frag", "sig", "n", "c", "left", "weight", F.arrays_zip("keep", "rank").alias("z"))
    named = rows.join(labels.select(F.col("node").alias("sig"), "component"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    return named.select("*", F.explode("z").alias("x")).select(F.col("x.keep").alias("h"), F.col("x.rank").alias("rank"), *[c for c in named.columns if c != "z"])


def _other(rows: DataFrame, *on: str) -> DataFrame:
    return rows.select(*on, *[F.col(c).alias("y" if c == "sig" else f"{c}_y") for c in ("sig", "n", "c", "left", "rank", "component")])


def _alike() -> Column:
    """Sizes and places that allow a similarity of 3/4 to two sets whose rarest common element this is.

    The overlap, which reaches 3/7 of both sizes, has no element that is rarer in
    either, so it is no larger than what each set has from here on.
    """
    return (4 * F.least("n", "n_y") >= 3 * F.greatest("n", "n_y")) & (7 * F.least(F.col("c") - F.col("rank"), F.col("c_y") - F.col("rank_y")) >= 3 * (F.col("n") + F.col("n_y")))


def _counted(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """Of the pairs (x, y) those that may be similar by the kept elements they share, counted in each fragment and summed per pair.

    In a fragment where two sets share `met` kept elements they share at most
    those, what either doesn't keep of its piece, and elsewhere all that the
    one with less has elsewhere. A pair for which that is too little in any
    fragment is struck out; for the sum see _enough().
    """
    side = lambda k, p: cut.filter(F.size("keep") > 0).select(F.col("sig").alias(k), "frag", *[F.col(c).alias(f"{c}{p}") for c in ("n", "c", "left", "keep")], (F.size("part") - F.size("keep")).alias(f"rest{p}"), (F.col("c") - F.size("part")).alias(f"else{p}"))
    both = staged(pairs, "counted").join(side("y", "_y"), "y").join(side("x", ""), ["x", "frag"])
    met = F.size(F.array_intersect("keep", "keep_y"))
    may = 7 * (met + F.col("rest") + F.col("rest_y") + F.least("else", "else_y")) >= 3 * (F.col("n") + F.col("n_y"))
    per = both.select("x", "y", "n", "n_y", "left", "left_y", met.alias("met"), may.alias("may"))
    return per.groupBy("x", "y", "n", "n_y", "left", "left_y").agg(F.sum("met").alias("met"), F.min("may").alias("may")).filter(F.col("may") & _enough()).select("x", "y")


def _enough() -> Column:
    """Whether two sets that meet in `met` of their kept elements may be similar.

    All elements that they share and that come before either's last kept one
    are kept by both; after it the one whose last kept comes first has `left`
    shared elements. So met + that must reach 3/7 of both sizes.
    """
    return 7 * (F.col("met") + F.greatest("left", "left_y")) >= 3 * (F.col("n") + F.col("n_y"))


def _rank(turn: int) -> Column:
    """Leaders are the sets of least rank: in the first round the weightiest, later ones drawn by a hash."""
    drawn = F.xxhash64("sig", F.lit(turn))
    return drawn if turn else F.pmod(drawn, F.lit(1 << 20)) - F.col("weight") * (1 << 20)


def _led(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs x (a list's leader), y (one of its members in another component), counted over the lists it leads; of a member's leaders the best."""
    ranked = rows.withColumn("rank", _rank(turn))
    lead = ranked.groupBy("h").agg(F.min("rank").alias("lead"), F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1").select("h", "lead")
    led = ranked.join(lead, "h")
    heads, members = led.filter("rank = lead").withColumnRenamed("sig", "x"), _other(led.filter("rank <> lead"), "h")
    met = heads.join(members, "h").filter((F.col("component") != F.col("component_y")) & (4 * F.least("n", "n_y") >= 3 * F.greatest("n", "n_y")) & (7 * F.least("c", "c_y") >= 3 * (F.col("n") + F.col("n_y"))))
    per = met.groupBy("x", "y", "frag").agg(F.count("*").alias("met")).groupBy("x", "y").agg(F.sum("met").alias("met"))
    return per.groupBy("y").agg(F.max_by("x", F.struct("met", "x")).alias("x")).select("x", "y")


def _across(rows: DataFrame) -> DataFrame:
    """Pairs of members of different components that meet in a list where their rarest common element may be. Lists of over BLOCK members are cut into blocks."""
    mixed = rows.groupBy("h").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("n").alias("least"), F.count("*").alias("members")).filter("c0 <> c1")
    # Without a set in the list small enough for its c, a member has no partner there.
    rest = rows.join(mixed.select("h", "least", F.ceil(F.col("members") / BLOCK).alias("blocks")), "h").filter("7 * c >= 3 * (n + least)")
    left = rest.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).withColumnRenamed("sig", "x")
    right = _other(rest.withColumn("block", F.pmod(F.xxhash64("sig"), "blocks")), "h", "block")
    met = left.join(right, ["h", "block"]).filter((F.col("component") < F.col("component_y")) & _alike())
    return met.select("x", "y").distinct()


def links(docs: DataFrame, described: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """classes (sig, n, doc_id: the least of the class) and components (node, component) over sigs that link with others."""
    classes = staged(described.filter("sig IS NOT NULL").groupBy("sig").agg(F.max("n").alias("n"), F.min("doc_id").alias("doc_id")), "classes")
    wanted = staged(survivors(classes, prefix_rows(docs, text)), "wanted")
    sets = staged(full_sets(docs, wanted, id_col, text), "sets")
    enough = _shared_counts(whole_rows(sets)).join(wanted.select("sig", "n"), "sig").filter("4 * c >= 3 * n").select("sig")
    cut = staged(fragments(sets.join(staged(enough, "enough").hint("merge"), "sig", "left_semi")), "fragments")

    found = classes.limit(0).select(F.col("sig").alias("a"), F.col("sig").alias("b"))
    labels = classes.limit(0).select(F.col("sig").alias("node"), F.col("sig").alias("component"))
    for turn in range(LEADER_ROUNDS):
        found = found.unionByName(staged(_links(_led(_lists_of(cut, labels), turn), cut, classes), "near"))
        labels = components(found)
    found = found.unionByName(_links(_counted(_across(_lists_of(cut, labels)), cut), cut, classes))
    return classes, components(found)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links of similarity 3/4 or more).

    One row per input row. A null or empty text, or one of white space, has no
    shingles and is its own component. Null ids count only where a component has
    no other id. Other columns are not read.
    """
    out = _placed(docs, id_col, text, staged(describe(docs, id_col, text), "described"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def heads(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """key (row_key), copies (long): of each component the row with the least id (null last), then key, and how many rows have that key.

    Rows without shingles are components of their own, by key.
    """
    described = staged(describe(docs, id_col, text, row_key(id_col, text)), "described")
    out = _placed(docs, id_col, text, described).select("doc_id", "key", "component")
    one = out.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("head")).select("head.key")
    chosen = one.unionByName(out.filter("component IS NULL").select("key").distinct())
    return chosen.join(out.groupBy("key").agg(F.count("*").alias("copies")), "key")


def _placed(docs: DataFrame, id_col: str, text: str, described: DataFrame) -> DataFrame:
    """described with component (null without shingles) and component_id."""
    classes, reached = links(docs, described, id_col, text)
    named = classes.select("sig", F.col("doc_id").alias("least")).join(reached.withColumnRenamed("node", "sig"), "sig", "left")
    named = named.withColumn("component", F.coalesce("component", "sig"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = named.select("sig", "component").join(least, "component").select("sig", "component", "component_id")
    return described.join(by_class, "sig", "left")
