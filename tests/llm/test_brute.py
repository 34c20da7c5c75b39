"""Operators and registered queries against brute-force versions on small data."""

import collections
import hashlib
import html
import math
import random
import re
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from relweave.llm import bpe, compression, decontamination, jaccard_join, line_dedup, quality_rules, queries, sharding, site_templates, toxicity
from relweave.llm.components import components
from relweave.llm.labelled import fold
from relweave.llm.shingles import shingle_sets
from relweave.llm.terms import terms


def documents(spark, small):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}


# --- sharding

def test_reweighting_moves_rows_only_into_and_out_of_the_changed_subtree(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    tree = sharding.HashTree.uniform(24)
    heavier = tree.reweighted(5, 3.0)
    both = sharding.place(sharding.place(rows, tree), heavier, prefix="new_")
    moved = both.filter("shard <> new_shard")
    assert moved.count() > 0
    # At every level rows move into the child whose weight rose, and nowhere else.
    assert moved.filter("region <> new_region AND new_region <> 'g0'").count() == 0
    assert moved.filter("region = new_region AND rack <> new_rack AND new_rack <> 'g0/k1'").count() == 0
    assert moved.filter("rack = new_rack AND new_shard <> 5").count() == 0
    shares = {r["new_shard"]: r["count"] for r in both.groupBy("new_shard").count().collect()}
    assert abs(shares[5] / 20_000 - 3 / 26) < 0.01 and all(abs(n / 20_000 - 1 / 26) < 0.008 for s, n in shares.items() if s != 5)


def test_growing_takes_rows_only_into_the_new_shard(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    tree = sharding.HashTree.uniform(24)
    for _ in range(3):
        grown = tree.grow()
        both = sharding.place(sharding.place(rows, tree), grown, prefix="new_")
        targets = {r[0] for r in both.filter("shard <> new_shard").select("new_shard").distinct().collect()}
        assert targets == {len(grown.leaves) - 1}
        tree = grown
    with pytest.raises(ValueError):
        sharding.HashTree(())


def test_draws_against_the_definition(spark):
    """Every level's smallest draw, from the 64-bit hash's own library; a null key is hashed as nothing."""
    import xxhash

    tree = sharding.HashTree.uniform(24).reweighted(3, 2.5).grow()

    def draw(key, depth, child, weight):
        h = 42
        for part in ([] if key is None else [struct.pack("<q", key)]) + [struct.pack("<i", depth), child.encode()]:
            h = xxhash.xxh64_intdigest(part, h)
        return -math.log(((h >> 11) + 0.5) / 2.0**53) / weight

    def place(key):
        at, path = "", []
        for depth in range(3):
            at = min(tree.children(depth)[at].items(), key=lambda c: draw(key, depth, *c))[0]
            path.append(at)
        return path[0], path[1], int(path[2])

    keys = [None, 0, -5, *range(1, 400), 2**60]
    rows = sharding.place(spark.createDataFrame([(k,) for k in keys], "doc_id bigint"), tree).collect()
    assert {(r["doc_id"], r["region"], r["rack"], r["shard"]) for r in rows} == {(k, *place(k)) for k in keys}


# --- quality rules

def measures(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    places = collections.defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    covered = {j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    texts += ["a\nb\na\n \n \na", "x" * 70_000, "é \x0b\x0c|# 漢字\r\n\tq", "AA BB!! cc"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {r["doc_id"]: tuple(r[m] for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in quality_rules.measure(df).collect()}
    assert got == {i: measures(t) for i, t in enumerate(texts)}


def test_ablations_count_what_each_rule_alone_rejects(spark):
    bits = [0, 0, 1, 2, 3, 4, 4, 6, 32]
    book = spark.createDataFrame([(b,) for b in bits], "fail_bits bigint")
    for r in quality_rules.ablations(book, "web-1").collect():
        m = quality_rules.mask([r["rule"]])
        assert r["n_failed"] == sum(1 for b in bits if b & m) and r["n_only"] == sum(1 for b in bits if b == m)
        assert r["kept_without"] == sum(1 for b in bits if b & ~m == 0)
    assert book.filter(quality_rules.passes("base-1")).count() == sum(1 for b in bits if b & 3 == 0)


# --- decontamination

def hits(words, windows):
    found, items = set(), set()
    for n in {len(w) for w in windows}:
        for i in range(len(words) - n + 1):
            owners = windows.get(tuple(words[i : i + n]))
            if owners:
                found.update(range(i, i + n))
                items |= owners
    return found, items


def windows_of(items, window=10):
    out = collections.defaultdict(set)
    for item, text in items:
        w = terms((text or "").encode())
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            out[tuple(w[i : i + n])].add(str(item))
    return out


def test_decontamination_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh")
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 5])))) for i in range(30)] + [(99, "a b a b a b a b"), (98, "a a a a")]
    docs = [(i, ". ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(60)]
    got = decontamination.contamination(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"), window=4).collect()
    windows = windows_of(items, 4)
    text = dict(docs)
    for r in got:
        found, owners = hits(terms(text[r["doc_id"]].encode()), windows)
        assert r["n_hit"] == len(found) and r["items"] == sorted(owners)
        assert {i for s in r["spans"] for i in range(s["first"], s["end"])} == found


def near_items(docs, items, count, span):
    """Row number -> item ids whose rarest terms stand within a span, by sliding over every place."""
    words = {i: terms((t or "").encode()) for i, (_, t) in enumerate(docs)}
    freq = collections.Counter(w for ws in words.values() for w in ws)
    out = {i: set() for i in words}
    for item, text in items:
        ws = terms((text or "").encode())
        rarest = sorted(set(ws), key=lambda w: (freq[w], ws.index(w)))[:count]
        if rarest and freq[rarest[0]]:
            for i, dw in words.items():
                if any(set(rarest) <= set(dw[k : k + span]) for k in range(len(dw))):
                    out[i].add(str(item))
    return out


@pytest.mark.parametrize("segment", [1 << 17, 40, 1])
def test_proximity_and_phrases_whatever_the_segments(spark, monkeypatch, segment):
    """Neighbours in a segment don't lend each other words; segments of one document and of many give the same."""
    monkeypatch.setattr(decontamination, "SEGMENT", segment)
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghijkl")
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 6, 8, 9])))) for i in range(12)] + [(50, "a zzz b"), (51, ""), (0, "q r s")]
    docs = [(i % 50, " ".join(word() for _ in range(rng.choice([0, 1, 2, 30, 90])))) for i in range(70)] + [(90, None), (91, "a b c"), (91, "a b c")]
    rows = decontamination.contamination(spark.createDataFrame(docs, "doc_id int, text string").repartition(2), spark.createDataFrame(items, "item_id int, text string"), window=5).collect()
    want = near_items(docs, items, decontamination.NEAR_TERMS, decontamination.NEAR_SPAN)
    windows = windows_of(items, 5)
    expected = collections.Counter((i, len(terms((t or "").encode())), len(hits(terms((t or "").encode()), windows)[0]), tuple(sorted(want[k]))) for k, (i, t) in enumerate(docs))
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["near"])) for r in rows) == expected
    assert any(set(r["near"]) - set(r["items"]) for r in rows) and any(not r["near"] for r in rows)


# --- encoding

CODEC = bpe.load("word_bpe_49k.json")


def assert_encodes_like_the_library(text):
    ids = CODEC.whole.encode(text, add_special_tokens=False).ids
    packed, decoded = CODEC.encode(text.encode())
    assert packed == struct.pack(f"<{len(ids)}I", *ids)
    assert decoded.decode() == CODEC.whole.decode(ids, skip_special_tokens=False) == CODEC.decode(packed)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aAéÉßΣσ's tdlv019!?*# </w>́\n\t\x1c\x85日x🙂ǅİ|_")), max_size=60))
def test_bpe_property(text):
    assert_encodes_like_the_library(text)


def test_bpe_query(spark, small):
    texts = documents(spark, small)
    for r in queries.op6_bpe(spark, small).collect():
        ids = CODEC.whole.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(CODEC.whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_forced_cuts_separate_pairs_that_no_token_has():
    assert CODEC.cuts("the") == ["the"]
    lacking = next(a + b for a in "qxzjvk" for b in "qxzjvk" if a + b not in CODEC.pairs)
    assert CODEC.cuts(f"a{lacking}a") == [f"a{lacking[0]}", f"{lacking[1]}a"]
    assert_encodes_like_the_library(f"pre{lacking}post")


# --- line hashing

def test_line_dedup_query(spark, small):
    texts, seen, want = documents(spark, small), {}, {}
    for i in sorted(texts):
        gone = {h for *_, h, x in line_dedup.units(texts[i].encode()) if h is not None and seen.setdefault((h, x), i) != i}
        want[i] = line_dedup.rebuild(texts[i].encode(), frozenset(gone))
    for r in queries.op8_line_dedup(spark, small).collect():
        text, units, spans = want[r["doc_id"]]
        assert (r["text"], r["n_units"], [s.asDict() for s in r["removed"]]) == (text.decode(), units, spans)


def test_units_tile_the_text_and_pasted_passages_go():
    rng = random.Random(2)
    sentence = lambda: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "é"]) + str(rng.randint(0, 999)) for _ in range(rng.randint(2, 12))) + ". "
    for _ in range(50):
        text = "".join(sentence() + rng.choice(["", "", "\n", "\n\n"]) for _ in range(rng.randint(0, 20))).encode()
        assert b"".join(text[a:b] + (b"\n" if text[b : b + 1] == b"\n" and (k == len(u) - 1 or u[k + 1][0] != n) else b"") for u in [list(line_dedup.units(text))] for k, (n, a, b, _, _) in enumerate(u)) == text
    passage = "".join(sentence() for _ in range(12))
    first, second = (f"{sentence()}{passage}{sentence()}".encode() for _ in range(2))
    known = {h for *_, h, _ in line_dedup.units(first) if h is not None}
    left = line_dedup.rebuild(second, frozenset(known))[0]
    assert len(left.split()) < len(second.split()) - 0.6 * len(passage.split())


def test_short_sentences_count_wherever_the_passage_stands():
    """A passage of three-word sentences goes from a line that begins with another short sentence, a lone short one stays, and halves of a digest don't count."""
    passage = " ".join(f"a{i} b{i} c{i}." for i in range(20))
    first, second = f"{passage} End here.".encode(), f"Odd one. {passage} Then this.".encode()
    known = frozenset(h for *_, h, _ in line_dedup.units(first) if h is not None)
    assert line_dedup.rebuild(second, known)[0] == b"Odd one. Then this."
    assert line_dedup.rebuild(b"x y z. a3 b3 c3. u v w.", known)[2] == []
    assert line_dedup.rebuild(second, frozenset(h[:8] + bytes(8) for h in known))[2] == []


def test_removed_spans_rebuild_the_text():
    rng = random.Random(9)
    word = lambda: rng.choice(["lorem", "ipsum", "dolor", "é", "amet"]) + str(rng.randint(0, 3))
    changed = 0
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(1, 30))) + rng.choice([".", "", " \t"]) for _ in range(6)]
        text = "".join(rng.choice(parts) + rng.choice([" ", "\n", "\n \n", "\n\n"]) for _ in range(rng.randint(0, 25))).encode()
        digests = [h for *_, h, _ in line_dedup.units(text) if h is not None]
        out, _, spans = line_dedup.rebuild(text, frozenset(h for h in digests if rng.random() < 0.3))
        left, at = b"", 0
        for x in spans:
            assert at < x["start"] < x["end"] or (at == x["start"] == 0 < x["end"])
            left, at = left + text[at : x["start"]], x["end"]
        assert left + text[at:] == out
        changed += bool(spans)
    assert changed > 20


def test_line_dedup_keeps_one_of_each_passage(spark):
    """Independent of the operator's units: by windows of 50 words over all texts, each stands once at most in what is left; ids are strings here."""
    rng = random.Random(44)
    word = lambda: rng.choice("bcdfgh") + rng.choice("aeiou") + str(rng.randint(0, 9999))
    passages = [[word() for _ in range(rng.randint(60, 110))] for _ in range(6)]
    style = [lambda w: " ".join(w), lambda w: ". ".join(w), lambda w: "\n".join(w), lambda w: " ".join(x + "." * (k % 7 == 6) for k, x in enumerate(w))]
    rows = []
    for i in range(40):
        body = [rng.choice(style)([word() for _ in range(rng.randint(3, 40))]) for _ in range(3)]
        if i % 2:
            body.insert(rng.randint(0, 3), rng.choice(style)(rng.choice(passages)))
        rows.append((f"id{i}" if i % 5 else None, rng.choice([" ", "\n", ". "]).join(body), i))
    df = spark.createDataFrame(rows, "doc_id string, text string, rank int").repartition(3)
    windows = lambda t: [tuple(w[k : k + 50]) for w in [re.findall("[a-z0-9]+", t.lower())] for k in range(len(w) - 49)]
    before = collections.Counter(x for _, t, _ in rows for x in set(windows(t)))
    out = line_dedup.dedup(df).collect()
    after = collections.Counter(x for r in out for x in set(windows(r["text"])))
    assert max(before.values()) > 1 and max(after.values()) == 1 and set(r["rank"] for r in out) == set(range(40))
    # Documents without a passage are left as they are, and each passage stays somewhere.
    assert all(r["text"] == t for r in out for _, t, k in rows if k == r["rank"] and k % 2 == 0)
    used = [p for p in passages if any(n > 1 for x, n in before.items() if x == tuple(p[:50]))]
    assert all(after[tuple(p[k : k + 50])] == 1 for p in used for k in range(len(p) - 49))


def test_no_planted_run_of_fifty_words_is_left():
    """Runs of 50 to 90 words, however they are written and wherever they stand, by windows of 50 that know nothing of units."""
    rng = random.Random(21)
    word = lambda: rng.choice("bcdfgh") + rng.choice("aeiou") + str(rng.randint(0, 9999))
    some = lambda low, high: [word() for _ in range(rng.randint(low, high))]
    forms = {
        "three-word sentences": lambda w: "".join(x + (". " if k % 3 == 2 else " ") for k, x in enumerate(w)),
        "no punctuation": " ".join,
        "five-word lines": lambda w: "".join(x + ("\n" if k % 5 == 4 else " ") for k, x in enumerate(w)),
        "one-word lines": "\n".join,
        "one sentence": lambda w: " ".join(w) + ".",
    }
    around = [lambda: "", lambda: "Odd one. ", lambda: " ".join(some(1, 40)) + " ", lambda: " ".join(some(1, 9)) + ".\n"]
    windows = lambda text: {tuple(w[k : k + 50]) for w in [re.findall("[a-z0-9]+", text.decode().lower())] for k in range(len(w) - 49)}
    for name, form in forms.items():
        for _ in range(40):
            run = some(50, 90)
            first, second = (f"{rng.choice(around)()}{form(run)} {rng.choice(around)()}".encode() for _ in range(2))
            other = f"{rng.choice(around)()}{rng.choice(list(forms.values()))(run)}".encode()
            known = frozenset(h for *_, h, _ in line_dedup.units(first) if h is not None)
            for text in (second, other):
                assert windows(text) & windows(first)
                assert not windows(line_dedup.rebuild(text, known)[0]) & windows(first), name
            twice = first + b" Between. " + second
            left = re.findall("[a-z0-9]+", line_dedup.rebuild(twice, frozenset())[0].decode().lower())
            assert sum(left[k : k + 50] == run[:50] for k in range(len(left))) <= 1, name


# --- Jaccard join

def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    least = {i: i for i in texts}

    def find(a):
        while least[a] != a:
            a = least[a]
        return a

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                least[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_join_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = {}
    passage = [rng.choice(vocabulary) for _ in range(30)]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 20, 60, 150]))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.4:
                w[2:2] = passage
            texts[len(texts)] = " ".join(w)
    texts |= {900: "", 901: "one two", 902: "ONE  two\n", 903: " "}
    df = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(df).collect()}
    want = brute_components(texts)
    assert got == want and len({c for _, c in want.values()}) < len(texts)


def test_prefixes_of_similar_sets_share_what_is_claimed():
    rng = random.Random(4)
    for _ in range(3000):
        n = rng.randint(1, 120)
        a = set(rng.sample(range(10_000), n))
        b = set(rng.sample(sorted(a), rng.randint((3 * n + 3) // 4, n))) | set(rng.sample(range(10_000, 20_000), rng.randint(0, n // 3)))
        if 100 * len(a & b) >= 75 * len(a | b):
            order = {x: rng.random() for x in a | b}
            p, q = (sorted(s, key=order.get)[: jaccard_join.prefix_length(len(s))] for s in (a, b))
            assert len(set(p) & set(q)) >= min(jaccard_join.slack(len(a)), jaccard_join.slack(len(b)))


def test_shingle_sets_depend_on_the_text_alone():
    texts = [b"a b c d e f", b"", b"x", b"A B c d e F g", b"a  b\tc\nd\x0be\x0cf\r"]
    together = [s.tolist() for s in shingle_sets(texts)]
    assert together == [next(shingle_sets([t])).tolist() for t in texts]
    assert [len(s) for s in together] == [2, 0, 1, 3, 2] and together[0] == together[4]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 299)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {k: 100 for k in range(101, 160)} | {300: 299}


# --- toxicity

@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=25))
def test_maximal_segments_against_the_recursive_definition(scores):
    """Best segment first (shortest among equals), then the same to its left and right. Scores are runs of drift and hits."""
    hits = [(i, float(abs(s) + 0.37 * (i % 5))) for i, s in enumerate(scores) if s > 0]
    drift = 0.9
    full = [-drift] * len(scores)
    for i, s in hits:
        full[i] = s

    def recurse(a, b):
        best = max(((sum(full[i:j]), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if best[0] <= 1e-9:
            return []
        i, j = -best[2], -best[2] - best[1]
        return [*recurse(a, i), (i, j - 1, round(best[0], 6)), *recurse(j, b)]

    got = [(a, b, round(s, 6)) for a, b, s in toxicity.maximal_segments(full)]
    assert got == recurse(0, len(scores))


def brute_toxicity(sample, texts):
    """Scores of texts by a model of sample (label, text), step by step, with segments from all sub-ranges."""
    import numpy as np

    from relweave.llm.calibration import fit_logistic, sigmoid

    words = [(y, terms(t.encode())) for y, t in sample]
    n = [sum(y == k for y, _ in words) for k in (0, 1)]
    names = {x for _, w in words for x in w}
    score = {}
    for f in names:
        c, t = (sum(f in w for y, w in words if y == k) for k in (0, 1))
        p = (c + t) / sum(n)
        raw = math.log((t + 10 * p) / (n[1] - t + 10 * (1 - p) + 1e-9)) - math.log((c + 10 * p) / (n[0] - c + 10 * (1 - p) + 1e-9))
        score[f] = math.copysign(max(0.0, abs(raw) - toxicity.CREDIBLE * math.sqrt(1 / (t + 10 * p) + 1 / (c + 10 * p))), raw)
    of = lambda x: score.get(x, 0.0)
    clean = [of(x) for y, w in words if not y for x in w]
    drift = toxicity.MARGIN + sum(clean) / len(clean)
    low, high = 0.0, 1.0
    total = lambda r: sum(math.exp(r * (s - drift)) for s in clean) / len(clean)
    assert max(clean) > drift
    while total(high) < 1:
        high *= 2
    for _ in range(80):
        low, high = ((low + high) / 2, high) if total((low + high) / 2) < 1 else (low, (low + high) / 2)

    def segments(w):
        s = [of(x) - drift for x in w]

        def recurse(a, b):
            best = max(((sum(s[i:j]), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
            i, j = -best[2], -best[2] - best[1]
            return [] if best[0] <= 1e-9 else [*recurse(a, i), best[0], *recurse(j, b)]

        return [high * x - math.log(max(1, len(w))) for x in recurse(0, len(w))]

    log_k = float(np.median([max(segments(w), default=0.0) for y, w in words if not y])) + math.log(math.log(2))

    def evidence(w):
        found = [x - log_k for x in segments(w)]
        return math.asinh(max(found, default=-log_k)), math.log1p(sum(x >= -math.log(0.01) for x in found))

    traits = [evidence(w) for _, w in words]
    weights = fit_logistic(np.array(traits), np.array([y for y, _ in words], dtype=float))
    return [sigmoid(sum(a * b for a, b in zip(weights, (*evidence(terms(t.encode())), 1.0), strict=True))) for t in texts]


def test_toxicity_against_a_brute_force_model(spark):
    rng = random.Random(17)
    calm, foul = [f"calm{c}{d}" for c in "abcdef" for d in "xyz"], ["vileness", "vilest", "grossly", "nasty"]
    text = lambda y: " ".join(rng.choice(foul) if rng.random() < (0.35 if y else 0.01) else rng.choice(calm) for _ in range(rng.randint(4, 14)))
    sample = [(int(i % 3 == 0), text(i % 3 == 0)) for i in range(90)]
    others = [text(i % 2) for i in range(20)] + ["", "vilely said", "unknown words"]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(sample)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, (y, _) in enumerate(sample)], "doc_id bigint, toxic int")
    assert len({t for _, t in sample}) == len(sample)
    model = toxicity.fit(docs, labels, "toxic", F.col("doc_id") < 0)
    got = toxicity.segments(spark.createDataFrame(list(enumerate(others)), "i int, text string"), model, "text", ["i"]).collect()
    want = brute_toxicity(sample, others)
    # The curve is set to the shares of all labels, counted with half a document more of each.
    shift = math.log(30.5 / 60.5) - math.log(30 / 60)
    assert all(math.isclose(math.log(r["score"] / (1 - r["score"])), math.log(want[r["i"]] / (1 - want[r["i"]])) + shift, abs_tol=1e-3) for r in got)
    assert max(want) > 0.8 and min(want) < 0.2


def test_compression_score_is_the_calibrated_size_difference(spark):
    """The score by the library's one-call interface, and the curve by its own likelihood: no other weight does better."""
    import zstandard as zs

    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["river", "stone", "cloud", "slowly", "walked", "the", "a"]) for _ in range(rng.randint(5, 300)))
    bad = lambda: " ".join(rng.choice(["$$$", "###", "CLICK", "the", "a", "BUY"]) + str(rng.randint(0, 9)) for _ in range(rng.randint(5, 300)))
    rows = [(i, good() if (i % 2) ^ (i % 11 == 0) else bad()) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    model = compression.fit(docs, labels, "quality", F.lit(False))
    dictionaries = [zs.ZstdCompressionDict(x) for x in (model.bad, model.good)]

    def difference(text):
        sizes = [sum(len(zs.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(text[k : k + 1024])) for k in range(0, max(1, len(text)), 1024)) for d in dictionaries]
        return (sizes[0] - sizes[1]) / sum(sizes)

    for r in compression.scored(docs.limit(60), model, "text", ["doc_id"]).collect():
        x = difference(dict(rows)[r["doc_id"]].encode())
        assert math.isclose(r["difference"], x, abs_tol=1e-12) and math.isclose(r["score"], 1 / (1 + math.exp(-(model.weight * x + model.intercept))), rel_tol=1e-9)
    assert model.weight > 0


@pytest.mark.parametrize(("query", "label"), [(queries.op7_compression, "quality"), (queries.op9_toxicity, "toxic")])
def test_held_out_accuracy(spark, query, label):
    folder = "/root/testdata/sf0.01"
    rows = query(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    right = sum(r["predicted"] == r[label] for r in held)
    assert len(held) > 50 and right / len(held) > 0.93


def test_compression_tells_good_from_bad_and_ignores_held_out_labels(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["river", "stone", "cloud", "morning", "slowly", "walked", "the", "a"]) for _ in range(120))
    bad = lambda: " ".join(rng.choice(["$$$", "###", "CLICK", "%%%", "&&&", "BUY"]) + str(rng.randint(0, 99)) for _ in range(120))
    docs = spark.createDataFrame([(i, good() if i % 2 else bad()) for i in range(300)], "doc_id bigint, text string")
    held_out = fold("doc_id", 4) == 2
    labels = docs.select("doc_id", F.when(held_out, 1 - F.col("doc_id") % 2).otherwise(F.col("doc_id") % 2).alias("quality"))
    model = compression.fit(docs, labels, "quality", held_out)
    scores = {r["doc_id"]: r["score"] for r in compression.scored(docs, model, "text", ["doc_id"]).collect()}
    assert all((scores[i] > 0.5) == bool(i % 2) for i in scores)


# --- site templates

def test_recurring_subtrees_outside_marked_articles_go(spark):
    page = lambda i, extra: f"<html><body><div>Welcome to the site, visitor {i}</div><div><p>Own text number {i} of page {'abcdefghij'[i]}.</p>{extra}</div></body></html>"
    rows = [(i, "http://h.example/" + str(i), page(i, "<p>Follow us</p>")) for i in range(8)] + [(50, "http://other.example/", page(9, "<p>Follow us</p>"))]
    got = {r["page_id"]: r["text"] for r in site_templates.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == {i: f"Own text number {i} of page {'abcdefghij'[i]}." for i in range(8)} | {50: "Welcome to the site, visitor 9\nOwn text number 9 of page j.\nFollow us"}


def test_paragraphs_of_marked_articles_and_copies_of_pages_stay(spark):
    article = "<article><h1>T</h1><p>Same licence line.</p><p>Body {}</p><div>Share this</div></article><div class='x-ad'>Buy</div>"
    rows = [(i, "http://h.example/", article.format("abcdefgh"[i])) for i in range(8)] + [(i, "http://c.example/", "<div>copied page</div>") for i in range(10, 30)]
    got = {r["page_id"]: r["text"] for r in site_templates.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == {i: f"T\nSame licence line.\nBody {'abcdefgh'[i]}" for i in range(8)} | {i: "copied page" for i in range(10, 30)}


def test_a_notice_on_a_small_share_of_a_large_host_goes(spark):
    """8 of 40 and 8 of 200 different pages make a template, 5 of 200 (fewer than the logarithm) and 4 of 40 none."""
    word = lambda i: "".join("abcdefghij"[int(d)] for d in str(i))
    page = lambda i: f"<div>{'<div>Rotating notice</div>' if i < 8 else ''}{'<div>Rare line</div>' if i < rare else ''}<p>Own text {word(i)} goes on for quite some words</p></div>"
    for n, rare in ((40, 4), (200, 5)):
        df = spark.createDataFrame([(i, "http://h.example/", page(i)) for i in range(n)], "page_id int, url string, html string")
        got = {r["page_id"]: r["text"] for r in site_templates.extract(df).collect()}
        assert got == {i: ("Rare line\n" if i < rare else "") + f"Own text {word(i)} goes on for quite some words" for i in range(n)}


def test_templates_alone_leave_the_article(spark):
    """Without any rule about elements or class names: pages of two sections of a host, each with its own menu, notice, advert and footer."""
    rng = random.Random(12)
    sentence = lambda: " ".join(rng.choice(["river", "stone", "cloud", "grass", "walks", "slowly"]) + rng.choice("abcdefgh") for _ in range(rng.randint(8, 20)))
    rows, want = [], {}
    for section, menu in enumerate(("News Sport", "Shop Help")):
        links = "".join(f"<li><a href='/{w}?s={section}'>{w}</a></li>" for w in menu.split())
        for k in range(3):
            i, body = 10 * section + k, [sentence() for _ in range(rng.randint(1, 4))]
            page = f"<html><head><title>t{k}</title></head><body><div><ul>{links}</ul></div><div><p>Notice of section {menu}</p></div><div><h1>Head {sentence()}</h1>{''.join(f'<p>{b}</p>' for b in body)}</div><div>Advert for {menu}, no. {k}</div><div>&copy; {menu} <b>2024-0{k + 1}</b></div></body></html>"
            rows.append((i, f"https://one.example/{i}", page))
            want[i] = page.split("<h1>")[1].split("</h1>")[0] + "\n" + "\n".join(body)
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    assert {r["page_id"]: r["text"] for r in site_templates.extract(pages, markup=False).collect()} == want
    # On a host with two pages nothing recurs often enough.
    few = site_templates.extract(pages.filter("page_id < 2"), markup=False).collect()
    assert len(few) == 2 and all("Notice of section" in r["text"] for r in few)


def test_shapes_alone_leave_the_article_of_every_host(spark):
    """Menus, adverts and footers that no two pages share word for word."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("host", site_templates.host(F.col("url")))
    large = pages.join(pages.groupBy("host").count().filter("count >= 20"), "host", "left_semi").select("page_id", "url", "html")
    sources = {r["page_id"]: r["html"] for r in large.collect()}
    right = 0
    for r in site_templates.extract(large, markup=False).collect():
        article = re.search("<article>(.*?)</article>", sources[r["page_id"]], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", s)).split()) for s in re.split("</?p>|</?h1>", article)]
        right += r["text"] == "\n".join(b for b in blocks if b)
    assert len(sources) >= 20 and right >= 0.9 * len(sources)


def test_shapes_of_an_article_are_no_template(spark):
    """What recurs in shape inside an article stays: lists, asides of the text's own kind, introductions, leading blocks."""
    word = lambda i: "".join("abcdefghij"[int(d)] for d in f"{i:03}")
    body = lambda i: f"<h1>On {word(i)}</h1><div class='lead'><p>First {word(i)} said a word.</p></div><ul><li>one {word(i)}</li><li>two {word(i)}</li></ul><table><tr><td>{word(i)}</td></tr></table><p>{' '.join(word(i * k % 997) for k in range(40))}</p><section><p>Last {word(i)}.</p></section>"
    menu = lambda i: f"<div><a href='/{i}'>{word(i)}</a> <a href='/x'>{word(i + 1)}</a></div>"
    want = lambda i: "\n".join([f"On {word(i)}", f"First {word(i)} said a word.", f"one {word(i)}", f"two {word(i)}", word(i), " ".join(word(i * k % 997) for k in range(40)), f"Last {word(i)}."])
    for form in ("<body>{menu}<article>{body}</article></body>", "<body>{menu}<div id='c'>{body}</div><div class='f'>Words of {word}</div></body>"):
        df = spark.createDataFrame([(i, "http://h.example/", form.format(menu=menu(i), body=body(i), word=word(i))) for i in range(30)], "page_id int, url string, html string")
        for markup in (True, False):
            assert {r["page_id"]: r["text"] for r in site_templates.extract(df, markup=markup).collect()} == {i: want(i) for i in range(30)}, (form, markup)


def test_templates_leave_long_and_marked_subtrees():
    copies = "<div><article><p>the same article</p></article></div><div><p>aside</p><div>x</div></div>"
    found = site_templates.subtrees(copies)
    assert [i for i, _ in found] == [0, 0, 1, 1, 2, 2] and len({h for _, h in found}) == 6  # the second div, its div and its paragraph, each by its text and by its shape
    assert site_templates.main_text(copies, frozenset(range(9))) == "the same article"
    assert site_templates.main_text(copies, frozenset(range(9)), markup=False) == "the same article"
    one = "<div>nearly all of the text</div><p>no</p>"
    assert [h for _, h in site_templates.subtrees(one)] == [site_templates.parse(one).children[1].sig - (1 << 63)]
    same = lambda a, b: site_templates.parse(a).sig == site_templates.parse(b).sig
    assert same("<p>a  1</p>", "<p>a\n27</p>") and not same("<p>a</p>", "<b>a</b>") and not same("<p><b>a</b></p>", "<p><b></b>a</p>")


def test_names_are_of_their_element():
    text = site_templates.main_text
    assert text("<div class='content has-sidebar'>kept</div><div class='sidebar'>gone</div>") == "kept"
    assert text("<article><div class='post-body comments-open share-enabled'>kept</div><div class='post-comments x'>gone</div><div class='user-comments'>gone</div></article>") == "kept"
    assert text("<div class=search>only this</div>") == "only this"
    assert text("<article><p>a</p><div class='search-engine-history'>its history</div><p class='notice'>take note</p></article>") == "a\nits history\ntake note"
    assert text("<div>x</div><div class='share-price'><p>All the text of the page</p></div>") == "x\nAll the text of the page"
    assert text("<div>x</div><div class='share'><p>All the text of the page</p></div>") == "x\nAll the text of the page"
    assert text("<div class='site-footer'>f</div><div id='cookie-banner'>c</div><div class='comments-area'>r</div><p>the text of the page</p>") == "the text of the page"


def test_broken_markup_takes_linear_time():
    import time

    for unit in ("<a ", "<a <b", "<div>", "<b>", "<!", "</b>", "<p>", "<a x='", '<a x="\'>', "<li>"):
        took = []
        for n in (4_000, 16_000):
            began = time.process_time()
            site_templates.main_text(unit * n)
            site_templates.subtrees(unit * n)
            took.append(time.process_time() - began)
        assert took[1] < 10 * max(took[0], 0.02), unit


def test_markup():
    text = site_templates.main_text
    assert text("<nav>x<div>menu</div></nav><p>plain &lt;b&gt; &eacute;&#233;\n\n text</p>tail <script>if(a<b)'</p>'</script>end<div hidden>no</div><!-- <p>c</p> -->") == "plain <b> éé text\ntail end"
    assert text("<main><header>Kept</header><p>One<br>two<p>Four <i>em</i>ph<ul><li>a<li>b</ul><form>f</form><section id=comments><article class=comment>hey</article></section><table><tr><td>c1<td>c2</table></main><footer>f</footer>") == "Kept\nOne two\nFour emph\na\nb\nc1\nc2"
    assert text("<nav>never closed <article><p>here</p></article>") == "here"
    assert text("<div>" * 5000 + "deep") == "deep"


def test_pages_query(spark, small):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}

    for r in queries.op5_site_templates(spark, small).collect():
        article = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", s)).split()) for s in re.split("</?p>|</?h1>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


# --- pipeline

def test_pipeline_against_brute_force(spark, small):
    texts = documents(spark, small)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    passed = {r["doc_id"] for r in quality_rules.ledger(spark.read.parquet(f"{small}/documents.parquet")).filter(quality_rules.passes("web-1")).collect()}
    texts = {i: t for i, t in texts.items() if i in passed}
    texts = {i: texts[i] for i, (_, c) in brute_components(texts).items() if i == c}
    seen, kept = {}, {}
    for i in sorted(texts):
        gone = {h for *_, h, x in line_dedup.units(texts[i].encode()) if h is not None and seen.setdefault((h, x), i) != i}
        kept[i] = line_dedup.rebuild(texts[i].encode(), frozenset(gone))[0].decode()
    windows = windows_of(items)
    want = {i: t for i, t in kept.items() if t.split() and not hits(terms(t.encode()), windows)[0]}
    rows = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"] for r in rows} == set(want) and len(rows) == len(want)
    for r in rows:
        ids = CODEC.whole.encode(want[r["doc_id"]], add_special_tokens=False).ids
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids) and r["n_tokens"] == len(ids)


def test_near_copies_go_whatever_their_ids(spark, small):
    """Near copies without ids, and those under an id that heads another group, leave one row a group; passages repeated among rows without ids go."""
    near = lambda c, end: " ".join([f"{c}{i}" for i in range(60)] + [end])
    rows = [(None, near("a", "x")), (None, near("a", "y")), (3, near("b", "x")), (None, near("b", "y")), (7, near("b", "z")), (7, near("c", "x")), (8, near("d", "x")), (8, near("d", "y"))]
    stayed = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), small).collect()
    assert sorted((r["doc_id"] or 0, r["text"][0]) for r in stayed) == [(0, "a"), (3, "b"), (7, "c"), (8, "d")] and len(stayed) == 4
    line = " ".join(f"word{i}" for i in range(25))
    docs = spark.createDataFrame([(None, f"{line}. First end."), (None, f"{line}. Other end.")], "doc_id bigint, text string")
    assert sorted(r["n_removed"] for r in line_dedup.dedup(docs).collect()) == [0, 1]


def test_pipeline_stages_keep_the_columns_and_take_odd_rows(spark, small):
    rows = [(1, "one two three four five six", "x"), (1, "one two three four five six", "x"), (None, None, None), (None, "a b", "y"), (None, "a b", "y"), (2, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.lit(1)).withColumn("sig", F.lit(0))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for some in (docs, docs.limit(0)):
            assert stage(spark, some, small).columns == docs.columns, name
    stayed = corpus_pipeline.near_duplicates(spark, docs, small).select("doc_id", "text").collect()
    assert sorted((r[0] or 0, r[1] or "") for r in stayed) == [(0, ""), (0, "a b"), (1, "one two three four five six"), (2, "")]
    assert math.isclose(docs.count(), 6)


def test_jaccard_join_with_one_shingle_in_all_documents(spark, monkeypatch):
    """A passage that every document has, in documents of all sizes; lists cut into many blocks, sums over many batches."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    monkeypatch.setattr(jaccard_join, "COMBINED", 40)
    rng = random.Random(30)
    passage = [f"p{i}" for i in range(12)]
    texts = {i: " ".join([*passage, *(f"w{rng.randrange(10_000)}" for _ in range(rng.randrange(14)))]) for i in range(150)}
    texts |= {200 + i: texts[i] for i in range(0, 60, 2)}
    texts |= {300 + i: " ".join([*passage[:5], *(f"v{rng.randrange(3)}" for _ in range(6))]) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id int, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(df).collect()}
    assert got == brute_components(texts)


def test_shared_counts_are_exact_whatever_the_batches(spark, monkeypatch):
    rng = random.Random(31)
    sets = {sig: sorted(rng.sample(range(40), rng.randint(1, 12))) for sig in range(30)} | {100: [1000], 101: [1000, 7], 102: [5000]}
    want = {k: sum(any(h in o for j, o in sets.items() if j != k) for h in s) for k, s in sets.items()}
    rows = [(k, s) for k, s in sets.items()] + [(k, sets[k]) for k in (1, 2, 100)]
    for combined in (1, 15, 1 << 20):
        monkeypatch.setattr(jaccard_join, "COMBINED", combined)
        df = spark.createDataFrame(rows, "sig bigint, elements array<bigint>").repartition(3)
        got = {r["sig"]: r["c"] for r in jaccard_join._shared_counts(jaccard_join.whole_rows(df)).collect()}
        assert got == want
