"""Vector codes, fill-in-middle and language identification against plain versions, and on odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from relweave.llm import fim, language_id, queries, vector_codes
from relweave.llm.labelled import fold

# --- vector codes


def plain_codes(rows, parts, entries, rounds, scale):
    """rows: (id, label, vector), usable ones alone, of one dimension. The contract in plain loops."""
    ints = [(i, lab, [math.floor(scale * x) for x in v]) for i, lab, v in rows]
    width = len(ints[0][2]) // parts if ints else 0
    cut = lambda v: [tuple(v[k * width : (k + 1) * width]) for k in range(parts)]
    cuts = [cut(v) for _, _, v in ints]
    order = sorted(range(len(ints)), key=lambda r: (ints[r][0] is None, ints[r][0], rows[r][2]))
    books = [[cuts[r][k] for r in order[:entries]] for k in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def nearest():
        return [[min((far(c[k], e), j) for j, e in enumerate(books[k])) for k in range(parts)] for c in cuts]

    for _ in range(rounds):
        at = nearest()
        for k in range(parts):
            for j in range(len(books[k])):
                mine = [cuts[r][k] for r in range(len(cuts)) if at[r][k][1] == j]
                if mine:
                    books[k][j] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
    at = nearest()
    errors = [sum(d for d, _ in a) for a in at]
    by_label = {}
    for (_, lab, _), e in zip(ints, errors, strict=True):
        by_label[lab] = by_label.get(lab, 0) + e
    out = [(i, "".join(f"{j:02x}" for _, j in a), e, by_label[lab]) for (i, lab, _), a, e in zip(ints, at, errors, strict=True)]
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), min_size=1, max_size=12), st.lists(st.tuples(st.integers(-12, 12), st.integers(-12, 12)), min_size=1, max_size=30), st.randoms())
def test_search_finds_what_comparing_with_all_finds(entries, parts, rng):
    book = vector_codes.Codebook(np.array(entries, dtype=np.int64))
    start = np.array([rng.randrange(len(entries)) for _ in parts])
    code, error, _ = book.search(np.array(parts, dtype=np.int64), start)
    want = [min(((a - x) ** 2 + (b - y) ** 2, j) for j, (x, y) in enumerate(entries)) for a, b in parts]
    assert [(int(e), int(c)) for e, c in zip(error, code, strict=True)] == want


def test_search_compares_few_entries_from_a_near_start():
    rng = np.random.default_rng(1)
    book = vector_codes.Codebook(rng.integers(-10_000, 10_000, (64, 2)))
    parts = book.entries[rng.integers(0, 64, 500)] + rng.integers(-200, 200, (500, 2))
    code, _, _ = book.search(parts, np.zeros(500, np.int64))
    again, _, compared = book.search(parts, code)
    assert (again == code).all() and compared < 500 * 6


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")


def test_codes_against_loops(spark):
    rng = random.Random(5)
    kept = [(i if i % 9 else None, rng.choice([None, 1, 2]), [rng.choice([-0.5, rng.gauss(0, 1)]) for _ in range(8)]) for i in range(1, 90)]
    kept += [(3, 1, kept[4][2]), (3, 1, kept[4][2]), (7, 2, [0.0] * 8)]
    odd = [(200, 1, None), (201, 1, [None] + [0.0] * 7), (202, 1, [float("nan")] * 8), (203, 1, [float("inf")] + [0.0] * 7)]
    df = vectors(spark, rng.sample(kept + odd, len(kept) + len(odd))).repartition(5).withColumn("code", F.lit("clash")).withColumn("a.b", F.lit(1))
    rows, books = vector_codes.encode(df, parts=4, entries=6, rounds=2)
    want, digest = plain_codes(kept, 4, 6, 2, 256)
    key = lambda r: (r[0] is None, *[x or 0 if i == 0 else x for i, x in enumerate(r)])
    assert sorted((tuple(r) for r in rows.select("vec_id", "code", "error", "label_error").collect()), key=key) == sorted(want, key=key)
    assert vector_codes.digest(books) == digest


def test_codes_of_few_other_and_no_vectors(spark):
    rows, books = vector_codes.encode(vectors(spark, [(1, None, [1.0, 2.0]), (2, 5, [1.0, 2.0, 3.0]), (3, 5, [1.0, 2.5]), (4, 5, [])]), parts=2)
    assert sorted(tuple(r) for r in rows.select("vec_id", "label", "code", "error", "label_error").collect()) == [(1, None, "0000", 0, 0), (2, 5, None, None, 0), (3, 5, "0001", 0, 0), (4, 5, None, None, 0)]
    rows, books = vector_codes.encode(vectors(spark, [(1, 1, None)]))
    assert rows.columns == ["vec_id", "label", "code", "error", "label_error"] and rows.count() == 0 and books == []
    with pytest.raises(ValueError):
        vector_codes.encode(vectors(spark, [(1, 1, [1.0, 2.0, 3.0])]), parts=2)
    with pytest.raises(ArithmeticError):
        vector_codes.encode(vectors(spark, [(1, 1, [1e30, 2.0])]), parts=2)


def test_codes_query(spark, small):
    source = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    want, digest = plain_codes([(r["vec_id"], r["label"], r["embedding"]) for r in source], 16, 64, 2, 256)
    rows = queries.QUERIES["op11_exponion"](spark, small).collect()
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in rows) == sorted(want)
    assert {r["codebooks_sha256"] for r in rows} == {digest}


# --- fill-in-middle


def plain_fim(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    return doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", "\n", "\n\n", "a", "a\nb", "a\nb\n", "x\r\ny\x0bz w\x85v\n\x00", "é\U0001f600\n" * 3, "with <S> inside", "< P>\n<\nS>\nM><\n<P", "<" * 50 + "\n" + ">" * 50, "line\n" * 40_000 + "end", "z" * 300_000, "same", "same"]


@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 0), (0, 100)])
def test_fim_against_a_regex(spark, rate, spm):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "q\nr\ns\n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("n", "form", "Output", "body", "draw")}).withColumn("a.b `c`", F.lit(1))
    chosen = fim.Settings(rate=rate, spm=spm)
    made = fim.transform(df, chosen).withColumn("back", fim.restored(F.col("output"), F.col("form"), chosen))
    assert set(made.columns) == {"doc_id", "body", "draw", "a.b `c`", "n", "form", "prefix_chars", "middle_chars", "output", "back"}
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
    assert sorted((tuple(r) for r in got), key=key) == sorted((plain_fim(i, t, rate, spm) for i, t in rows), key=key)
    assert sorted(r["back"] for r in made.select("back").collect()) == sorted(t or "" for _, t in rows)
    assert fim.transform(df.limit(0)).count() == 0


def test_fim_query(spark, small):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    source = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((i, n, form, p, m, sha(out), sha(t or "")) for (i, t), (_, n, form, p, m, out) in ((tuple(r), plain_fim(*r)) for r in source))
    assert sorted(tuple(r) for r in queries.QUERIES["op12_fim"](spark, small).collect()) == want


def test_fim_marks_that_could_meet_are_refused():
    for marks in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aa", "b", "c"), ("", "b", "c"), ("abc", "b", "d")):
        with pytest.raises(ValueError):
            fim.Settings(prefix=marks[0], suffix=marks[1], middle=marks[2])


# --- language identification


def test_language_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.QUERIES["op13_language_id"](spark, folder).collect()
    assert len(rows) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert sum(r["rejected"] for r in rows) <= 0.03 * len(rows)


def test_language_learns_from_training_rows_alone(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    held = fold("doc_id", 5) == 0
    a = language_id.fit(docs, held)
    b = language_id.fit(docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang"))).withColumn("text", F.when(held, F.lit("other words")).otherwise(F.col("text"))), held)
    assert a.languages == b.languages and (a.centroids == b.centroids).all() and (a.least, a.sharpness) == (b.least, b.sharpness)
    assert max(a.languages.count(n) for n in a.names) == language_id.CLUSTERS and np.allclose((a.centroids**2).sum(axis=0), 1, atol=1e-5)


def test_language_against_plain_cosines(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs, fold("doc_id", 5) == 0)

    def plain(text):
        words = b" " + b" ".join(re.sub(rb"[^a-z\x80-\xff]", b" ", text.lower().encode()).split()) + b" "
        counts = {}
        for n in (2, 3, 4):
            for i in range(len(words) - n + 1):
                h = ((int.from_bytes(words[i : i + n], "big") + n) * 2654435761 % 2**32) >> 17
                counts[h] = counts.get(h, 0) + 1
        weights = {h: (1 + math.log(c)) * model.rarity[h] for h, c in counts.items()}
        length = math.sqrt(sum(w * w for w in weights.values()))
        near = [sum(w * float(model.centroids[h, k]) for h, w in weights.items()) / length for k in range(len(model.languages))]
        return [max(near[k] for k in own) for own in model.of]

    for r in language_id.scored(docs.filter("doc_id % 9 = 0"), model, "text", ["text"]).collect():
        want = plain(r["text"])
        assert np.allclose(r["cosines"], want, atol=1e-4)
        assert want[model.names.index(r["lang_pred"])] >= max(want) - 1e-4
        assert r["rejected"] == (max(r["cosines"]) < model.least[r["lang_pred"]])


def test_language_of_odd_rows(spark):
    rows = [(i, f"the cat and the dog went {i} times to the house of {w}", "en") for i, w in enumerate(("ann", "bob", "eve", "tim") * 12)]
    rows += [(100 + i, f"le chat et le chien vont {i} fois chez {w}", "fr") for i, w in enumerate(("ann", "bob", "eve", "tim") * 12)]
    rows += [(300, "uno", "es"), (301, None, "en"), (302, "", None), (303, "12 34 !?", "fr"), (304, "le chat " * 50_000, None), (305, "漢字", None), (None, "the dog", "en"), (305, "the dog", "en"), (305, "the dog", "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({c: F.lit("clash") for c in ("score", "body", "lettered", "part")}).withColumn("a.b", F.lit(1))
    model = language_id.fit(df, F.lit(False))
    assert model.names == ["en", "es", "fr"]
    out = language_id.scored(df, model, "text", ["doc_id", "score", "a.b", "body", "lettered"])
    assert out.columns == ["doc_id", "a.b", "body", "lettered", "lang_pred", "score", "rejected", "cosines"]
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert got[301] == got[302] == got[303] == [("und", 0.0)] and got[304][0][0] == "fr" and got[300][0][0] == "es"
    assert got[305][1] == got[305][2] and got[305][1][0] == got[None][0][0] == "en"
    assert {r["lang_pred"] for r in language_id.scored(df.filter("doc_id = 305 AND text NOT LIKE '%dog'"), model, "text", [], reject=True).collect()} == {"und"}
    nothing = language_id.fit(df.limit(0), F.lit(False))
    assert [tuple(r) for r in language_id.scored(df.filter("doc_id = 300"), nothing, "text", ["doc_id"]).collect()] == [(300, "und", 0.0, False, None)]
    assert language_id.scored(df.limit(0), model, "text", ["doc_id"]).count() == 0
