"""The versioned store, copy-on-write, numbers for new rows, upserts by any key, change feeds and view changes against plain loops."""

import hashlib
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from relweave.operators import changes, dml
from relweave.plans import history
from relweave.sources import store as stores


@pytest.fixture
def store(spark, tmp_path):
    return stores.Store(spark, str(tmp_path / "store"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is None, str(x)) for x in r])


def files(store):
    return {os.path.join(d, f): hashlib.md5(open(os.path.join(d, f), "rb").read()).hexdigest() for d, _, fs in os.walk(store.root) for f in fs if not f.endswith(".crc") and f != "_SUCCESS"}


# --- batches


def test_a_failed_batch_leaves_no_trace_and_readers_keep_their_version(spark, store):
    assert store.version() == 0 and store.entries() == {}
    with store.batch() as b:
        b.put("t", spark.range(10), ["id"])
        b.put("u", spark.range(3))
    reader, before = store.read("t"), files(store)
    with pytest.raises(ZeroDivisionError), store.batch() as b:
        b.put("t", spark.range(5), ["id"])
        b.drop("u")
        assert b.read("t").count() == 5 and set(b.entries()) == {"t"}
        raise ZeroDivisionError
    assert files(store) == before and store.version() == 1
    with store.batch() as b:
        b.put("t", spark.range(5), ["id"])
        b.drop("u")
    assert (store.version(), store.read("t").count(), store.read("t", 1).count(), reader.count()) == (2, 5, 10, 10)
    with pytest.raises(KeyError):
        store.read("u")
    assert store.read("u", 1).count() == 3
    with store.batch():
        pass
    assert store.version() == 2


def test_of_two_batches_one_is_published(spark, store):
    with pytest.raises(stores.Conflict), store.batch() as late:
        late.put("t", spark.range(1))
        with store.batch() as b:
            b.put("t", spark.range(2))
    assert store.versions() == [1] and store.read("t").count() == 2 and len(os.listdir(f"{store.root}/data/t")) == 1


def test_vacuum_keeps_what_the_last_versions_have(spark, store):
    for n in (4, 5, 6):
        with store.batch() as b:
            b.put("t", spark.range(n), ["id"])
    os.utime(f"{store.root}/manifest/{3:020d}", (2e9, 2e9))
    store.vacuum(keep=2)
    assert store.versions() == [2, 3] and store.read("t").count() == 6 and store.read("t", 2).count() == 5
    store.vacuum()
    assert store.versions() == [3] and store.read("t").count() == 6
    assert len([p for p in files(store) if "/data/" in p]) == store.listing(store.entries()["t"]).count()


def test_empty_tables_odd_names_and_nulls(spark, store):
    with store.batch() as b:
        b.put("odd.name é", spark.createDataFrame([(1, None)], "`a b.c` int, v string"))
        b.put("none", spark.range(0), ["id"])
    assert rows(store.read("odd.name é")) == [(1, None)] and store.read("none").count() == 0
    with store.batch() as b:
        b.upsert("none", spark.range(2))
        b.delete("none", spark.range(1))
    assert rows(store.read("none")) == [(1,)]


def test_upserts_and_deletes_leave_other_files_as_they_are(spark, store):
    with store.batch() as b:
        b.put("t", spark.range(1000).select("id", (F.col("id") % 7).alias("v"), F.lit("x").alias("w")), ["id"], files=10)
    before = files(store)
    sent = spark.createDataFrame([(5, 50, 1), (5, 51, 2), (310, 70, 1), (5000, 80, 1), (None, 90, 1)], "id bigint, v bigint, at int")
    with store.batch() as b:
        kept = b.upsert("t", sent, order="at")
    assert 7 <= len(kept) <= 8 and all(before[f"{store.root}/{p}"] == files(store)[f"{store.root}/{p}"] for p in kept)
    want = {i: (i % 7, "x") for i in range(1000)} | {5: (51, "x"), 310: (70, "x"), 5000: (80, None)}
    assert {r["id"]: (r["v"], r["w"]) for r in store.read("t").collect()} == want and store.read("t").count() == len(want)
    with store.batch() as b:
        kept = b.delete("t", spark.createDataFrame([(6,), (777,), (8888,)], "id bigint"))
    assert len(kept) >= 7 and store.read("t").filter("id IN (6, 777)").count() == 0 and store.read("t").count() == len(want) - 2
    listed = {p["path"] for p in store.listing(store.entries()["t"]).collect()}
    assert set(kept) < listed
    with pytest.raises(ValueError), store.batch() as b:
        b.put("bare", spark.range(2))
        b.upsert("bare", spark.range(3))


@pytest.mark.parametrize("one_batch", [False, True])
def test_scripts_publish_with_their_history(spark, store, one_batch):
    files_ = spark.createDataFrame([("01.sql", "a"), ("02.sql", "b"), ("03.sql", "fails"), ("04.sql", "c")], "filename string, text string")

    def run(batch, text):
        batch.put(text, spark.range(1))
        if text == "fails":
            raise RuntimeError("no such table")

    failure = stores.migrate(store, files_, run, one_batch=one_batch)
    assert str(failure) == "no such table"
    names = set(store.entries()) - {stores.HISTORY}
    assert names == (set() if one_batch else {"a", "b"})
    done = {r["filename"]: r["success"] for r in store.read(stores.HISTORY).collect()}
    assert done == ({"03.sql": False} if one_batch else {"01.sql": True, "02.sql": True, "03.sql": False})
    mended = files_.withColumn("text", F.when(F.col("filename") == "03.sql", "d").otherwise(F.col("text")))
    assert stores.migrate(store, mended, run, one_batch=one_batch) is None
    assert set(store.entries()) == {"a", "b", "c", "d", stores.HISTORY} and history.pending(mended, store.read(stores.HISTORY)).count() == 0


# --- numbers and keys


def test_identity_is_gapless_and_stable(spark):
    target = spark.createDataFrame([(7, "a"), (3, "b")], "id int, v string")
    new = spark.createDataFrame([(None, f"n{i:03}") for i in range(300)] + [(9, "given")], "id int, v string")
    got = dml.with_identity(target, new.repartition(7), "id", ["v"]).collect()
    again = dml.with_identity(target, new.repartition(3), "id", ["v"]).collect()
    assert sorted(got) == sorted(again) and {r["v"]: r["id"] for r in got} == {f"n{i:03}": 10 + i for i in range(300)} | {"given": 9}
    assert rows(dml.with_identity(target.limit(0), new.limit(3), "id", ["v"])) == [(1, "n000"), (2, "n001"), (3, "n002")]


@pytest.mark.parametrize("seed", range(2))
def test_upsert_by_any_key_is_one_insert_at_a_time(spark, seed):
    rng = random.Random(seed)
    pick = lambda n: rng.choice([None, *range(n)]) if rng.random() < 0.9 else rng.randrange(n)
    target = [(i, 100 + i, f"t{i}", "old") for i in range(0, 12, 2)]
    sent = [(pick(40), pick(30) and pick(130), i, f"s{i}") for i in range(120)]
    there = [list(r) for r in target]
    for a, b, at, v in sent:
        hit = next((r for r in there if a is not None and r[0] == a), None) or next((r for r in there if b is not None and r[1] == b), None)
        if hit:
            hit[2] = v
        else:
            there.append([a, b, v, None])
    t = spark.createDataFrame(target, "a int, b int, v string, untouched string")
    s = spark.createDataFrame(rng.sample(sent, len(sent)), "a int, b int, at int, v string")
    got = dml.upsert_any_key(t, s, [["a"], ["b"]], ["at"])
    assert got.columns == t.columns and rows(got) == sorted((tuple(r) for r in there), key=lambda r: [(x is None, str(x)) for x in r])
    assert rows(dml.upsert_any_key(t, s.limit(0), [["a"], ["b"]], ["at"])) == rows(t)


# --- changes


def test_feed_and_stamps_tell_nulls_apart_from_values(spark):
    before = spark.createDataFrame([(1, "a", "t"), (2, None, "t"), (3, "c", None), (None, "n", "t")], "k int, v string, at string")
    after = spark.createDataFrame([(1, "a", "t"), (2, "b", "t"), (3, "c", "u"), (4, None, None), (None, None, "t")], "k int, v string, at string")
    got = {(r["k"], r["op"], r["before"] and r["before"]["v"], r["after"] and r["after"]["v"]) for r in changes.feed(before, after, ["k"]).collect()}
    assert got == {(2, "update", None, "b"), (3, "update", "c", "c"), (4, "insert", None, None), (None, "update", "n", None)}
    assert rows(changes.stamped(before, after, ["k"], "at", F.lit("now"))) == [(1, "a", "t"), (2, "b", "now"), (3, "c", "u"), (4, None, "now"), (None, None, "now")]
    assert changes.feed(before, before, ["k"]).count() == 0
    assert {r["op"] for r in changes.feed(before, after.limit(0), ["k"]).collect()} == {"delete"}


def test_view_changes_add_up(spark):
    rng = random.Random(3)
    kind = {"a": "id int, j int, x int", "b": "id int, j int, y int"}
    make = lambda n, name: spark.createDataFrame([(i, rng.randrange(6), rng.randrange(3)) for i in range(n) if rng.random() < 0.8], kind[name])
    before, after = ({n: make(40, n) for n in kind} for _ in range(2))
    view = lambda t: t["a"].join(t["b"].select("j", "y"), "j").filter("x <> 2 OR y = 1").select("j", "x", "y")
    change = {n: changes.feed(before[n], after[n], ["id"]) for n in kind}
    delta = changes.view_changes(view, before, change)
    want = Counter(rows(view(after)))
    want.subtract(Counter(rows(view(before))))
    assert {tuple(r)[:-1]: r["n"] for r in delta.collect()} == {k: n for k, n in want.items() if n}
    assert rows(changes.refreshed(view(before), delta)) == rows(view(after))
