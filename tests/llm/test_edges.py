"""Every operator on nulls, empty and very long texts, ties, repeated rows, an empty table and clashing extra columns."""

import hashlib
import zlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from relweave.llm import bpe, compression, decontamination, jaccard_join, line_dedup, quality_rules, sharding, site_templates, toxicity
from relweave.llm.labelled import fold

LONG = " ".join(f"w{i % 977}x{i % 7}" for i in range(60_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
    (1, "another text with the same id, said once and never more.", "en", "a"),
    (2, "The Quick brown fox jumps over the lazy dog again and again", None, None),
    (3, None, None, None),
    (4, "", "en", ""),
    (5, " \t\n\n", "en", "b"),
    (None, "a row without an id but with quite a few words in it", "en", "b"),
    (None, None, None, None),
    (6, LONG, "xx", "c"),
    (7, "\x1c\x85  é́ \U0001f600 <|endoftext|> İSTANBUL", "xx", "c"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for name in ("n_words", "ids", "decoded", "n_tokens", "score", "shard", "h", "sig", "n", "key", "entry", "body", "label", "n_units", "removed", "fail_bits", "size"):
        df = df.withColumn(name, F.lit("clash"))
    return df.withColumn("a.b `c`", F.lit("clash"))


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


ITEMS = [(10, "brown fox jumps over the lazy"), (10, "brown fox jumps over the lazy"), (11, None), (12, " .,; "), (13, "ABSENT"), (14, "QUITE")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("words", F.lit("clash"))


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, i % 2) for i in range(8)] + [(1, None, None), (None, 1, 1), (1, 0, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_sharding(docs, none):
    tree = sharding.HashTree.uniform(24)
    rows = sharding.shard(docs, tree, tree.grow()).collect()
    assert len(rows) == len(ROWS)
    by_id, by_shard = {}, {}
    for r in rows:
        by_id.setdefault(r["doc_id"], set()).add((r["shard"], r["grown_shard"]))
        by_shard.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(len(v) == 1 for v in by_id.values())
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    sizes = sorted(r["size"] for r in rows)
    assert sizes == sorted(8 + len((t or "").encode()) for _, t, _, _ in ROWS)
    crcs = {r["text_crc32"] for r in rows}
    assert crcs == {None if t is None else zlib.crc32(t.encode()) for _, t, _, _ in ROWS}
    assert sharding.shard(none, tree).collect() == []


def test_quality_rules(docs, none):
    rows = quality_rules.ledger(docs).collect()
    assert len(rows) == len(ROWS)
    blank = [r for r in rows if not (r["text"] or "").strip()]
    assert len(blank) == 4 and all(r[m] == 0 for r in blank for m in quality_rules.MEASURES)
    (long,) = [r for r in rows if r["doc_id"] == 6]
    assert long["n_words"] == 60_000 and long["n_repeat_words"] == 60_000
    assert quality_rules.ledger(none).collect() == []
    zero = quality_rules.ablations(quality_rules.ledger(none), "web-1").collect()
    assert {r["rule"] for r in zero} == set(quality_rules.POLICIES["web-1"]) and all(r["n_failed"] == r["n_only"] == r["kept_without"] == 0 for r in zero)


def test_decontamination(docs, none, items):
    rows = decontamination.contamination(docs, items).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        if r["doc_id"] == 2:
            assert (r["n_words"], r["n_hit"], r["items"], [tuple(s) for s in r["spans"]]) == (12, 6, ["10"], [(2, 8)])
        if r["doc_id"] in (3, 4, 5):
            assert (r["n_words"], r["n_hit"], r["items"]) == (0, 0, [])
    assert sorted(r["n_hit"] for r in rows if r["doc_id"] == 1) == [0, 6, 6]
    assert sorted(r["n_hit"] for r in rows if r["doc_id"] is None) == [0, 1]
    assert decontamination.contamination(none, items).collect() == []
    assert all(r["n_hit"] == 0 for r in decontamination.contamination(docs, items.limit(0)).collect())


def test_bpe(docs, none):
    rows = bpe.encode(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r["ids"] == b"" and r["decoded"] == "" and r["n_tokens"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))
    assert all(len(r["ids"]) == 4 * r["n_tokens"] and "text" not in r for r in rows)
    assert bpe.encode(none).collect() == []


def test_line_dedup(docs, none):
    rows = line_dedup.dedup(docs, min_words=6).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert sorted(r["n_removed"] for r in by[1]) == [0, 0, 0]
    assert [(r["text"], r["n_removed"], [tuple(s) for s in r["removed"]]) for r in by[2]] == [("", 1, [(0, 59)])]
    assert by[3][0]["text"] is None and by[3][0]["n_units"] == 0
    assert by[5][0]["text"] == " \t\n\n" and by[6][0]["text"] == LONG
    assert line_dedup.dedup(none).collect() == []


def test_jaccard_join(docs, none):
    rows = jaccard_join.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (None, None)}
    assert sorted(r["n_shingles"] for r in rows if r["doc_id"] in (3, 4, 5, None)) == [0, 0, 0, 0, 9]  # 13 words have 9 shingles
    assert jaccard_join.near_duplicates(none).collect() == []


def test_jaccard_join_of_repeated_rows_and_missing_ids(spark):
    """A set that comes twice isn't counted twice; rows without an id link like others."""
    words = [f"w{i}" for i in range(64)]
    far, near = " ".join(words[:50] + ["x"] * 14), " ".join([*words[:62], "y", "z"])  # 46 of 74, and 58 of 62 shingles shared
    base = " ".join(words)
    rows = [(20, base)] * 5 + [(21, far)] * 5 + [(None, near), (None, near), (None, "nothing like the others at all here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in jaccard_join.near_duplicates(df).collect())
    assert got == [(0, 0), (0, 20), (0, 20), *[(20, 20)] * 5, *[(21, 21)] * 5]


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_classifiers(docs, none, labels, label):
    held_out = fold("doc_id", 4) == 2
    for some_docs in (docs, none):
        for some_labels in (labels, labels.limit(0), labels.filter("doc_id IN (1, 5) AND toxic = 1")):
            for model, run in ((compression.fit, compression.scored), (toxicity.fit, toxicity.segments)):
                rows = run(docs, model(some_docs, some_labels, label, held_out), "text", ["doc_id"]).collect()
                assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)


def test_site_templates(spark):
    rows = [(1, "http://a.example/x", None), (2, None, "<p>x</p>"), (3, "no url", ""), (3, "no url", ""), (4, "http://a.example/y", "<article><p>" + LONG + "</article>"), (5, "HTTP://u:p@B.example:80/", "<div><p>unclosed <b>bold <p>next</div></div></p>")]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    pages = pages.withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash")).withColumn("template", F.lit("clash"))
    got = site_templates.extract(pages).collect()
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in got) == [(1, "", 0), (2, "x", 1), (3, "", 0), (3, "", 0), (4, LONG, len(LONG)), (5, "unclosed bold\nnext", 18)]
    assert site_templates.extract(pages.limit(0)).collect() == []
    assert pages.select(site_templates.host(F.lit("HTTP://u:p@B.example:80/"))).first()[0] == "b.example"


INTERNAL = ("_row", "_key", "_id", "_rank", "_print", "_gone", "_body", "_sig", "_label", "_m", "measured", "body_")


def test_internal_names_and_ids_as_text(spark, items, labels):
    """Columns named as operators name their own change no result, nor do ids that are text, but for which repeat stays."""
    plain = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    odd = texts = plain.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    for name in INTERNAL:
        odd = odd.withColumn(name, F.lit("clash"))
    tree = sharding.HashTree.uniform(24)
    ways = [
        (lambda df: sharding.shard(df, tree).groupBy("doc_id").agg(F.count_distinct("shard")), True),
        (lambda df: quality_rules.ledger(df).select("doc_id", *quality_rules.MEASURES), True),
        (lambda df: decontamination.contamination(df, items).select("doc_id", "n_words", "n_hit", "items"), True),
        (lambda df: bpe.encode(df).select("doc_id", "n_tokens", "ids"), True),
        (lambda df: line_dedup.dedup(df, min_words=6).select("doc_id", "text", "n_removed"), False),  # text ids have ranks of their own
        (lambda df: jaccard_join.near_duplicates(df).select("doc_id", "n_shingles"), True),
    ]
    as_text = lambda x: None if x is None else f"d{x}"
    for run, alike in ways:
        want = sorted(repr((as_text(r[0]), *r[1:]) if alike else tuple(r)) for r in run(plain if alike else texts).collect())
        assert sorted(repr(tuple(r)) for r in run(odd).collect()) == want
    told = labels.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    for model, run in ((compression.fit, compression.scored), (toxicity.fit, toxicity.segments)):
        rows = run(odd, model(odd, told, "toxic", F.lit(False)), "text", ["doc_id"]).collect()
        assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("model", [compression, toxicity])
def test_equal_texts_score_alike(spark, model):
    """Ties: copies of a text, the null text and the empty one have one score, whatever their partition and id."""
    rows = [(i, ("calm river stone " * 9) + str(i % 5) if i % 2 else "vile nasty $$$ " * (i % 3) + str(i % 5)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    fitted = model.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("quality")), "quality", F.lit(False))
    run = compression.scored if model is compression else toxicity.segments
    asked = spark.createDataFrame([*rows, *((100 + i, t) for i, t in rows), (None, ""), (7, None), (None, None)], "doc_id bigint, text string").repartition(4)
    scores = {}
    for r in run(asked, fitted, "text", ["text"]).collect():
        scores.setdefault(r["text"] or "", set()).add(r["score"])
    assert all(len(v) == 1 for v in scores.values()) and len(scores) == len({t for _, t in rows} | {""})


def test_pipeline_stages_on_odd_and_long_rows(spark, small, docs, none):
    """Each stage on nulls, repeated rows, long texts and clashing columns; encode returns its own columns."""
    for name in INTERNAL:
        docs = docs.withColumn(name, F.lit("clash"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, small)
        assert got.columns == docs.columns, name
        kept[name] = sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect())
    texts = sorted((i or 0, t or "") for i, t, _, _ in ROWS)
    assert [r[0] for r in kept["quality_rules"]] == []  # none has 20 words without repeats
    assert (6, LONG) in kept["ngram_jaccard_join"] and (6, LONG) in kept["substring_dedup"]
    assert kept["benchmark_decontamination"] == texts
    coded = corpus_pipeline.encode(spark, docs, small)
    assert coded.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    rows = coded.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r["ids_sha256"] == hashlib.sha256(r["ids"]).hexdigest() and len(r["ids"]) == 4 * r["n_tokens"]
        assert (r["n_tokens"] == 0) == (r["doc_id"] in (3, 4) or r["ids"] == b"")
    assert corpus_pipeline.encode(spark, none, small).collect() == []


def test_line_dedup_ranks_rows_that_share_an_id(spark):
    """The same 60 words in several texts of one id, of no id, and of the greatest id: one text keeps them."""
    words = " ".join(f"word{i}" for i in range(60)) + "."
    for ids in ([7, 7], [7, 7, 9], [None, None], [2**63 - 1, None, None], [5, 5, 5, None, 2**63 - 1]):
        rows = [(i, f"Own beginning {k} of this text. {words}") for k, i in enumerate(ids)]
        out = line_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        kept = [r["doc_id"] for r in out if "word59" in r["text"]]
        last = 2**63 - 1  # the rank of a row without an id, too
        assert len(kept) == 1 and (kept[0] or last) == min(i or last for i in ids)


def test_line_dedup_of_texts_that_repeat_themselves(spark):
    """Rewritten for their own repeats alone, or left as they are, a text has the sentences that it has."""
    long = " ".join(f"word{i}" for i in range(30))
    texts = [f"{long}. Between. {long}.", f"{long} else.\n\nNo repeat here! Is it?", "", "\n", "...", "a.b!c\nd"]
    out = {r["doc_id"]: r for r in line_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert out[0]["text"].count("word29") == 1 and out[0]["n_removed"] == 1 and all(out[i]["text"] == texts[i] for i in range(1, len(texts)))
    for i, t in enumerate(texts):
        assert out[i]["n_units"] == len(line_dedup._passages(t.encode())[0]) == line_dedup._count(t.encode())
