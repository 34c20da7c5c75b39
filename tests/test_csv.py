"""CSV files cut into ranges against Python's reader; loads where the last row stays; dumps in order, side by side."""

import csv
import io
import random
import threading
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.catalog import PRIMARY_KEY, Catalog, Column, Constraint, Table
from relweave.functions import codec
from relweave.sources import files, splits


@pytest.fixture
def small_ranges(spark):
    """Sessions setting that cuts files into ranges of about `n` bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def cut(n: int) -> None:
        spark.conf.set(names[0], str(n))
        spark.conf.set(names[1], "1")

    yield cut
    for n, v in before.items():
        spark.conf.set(n, v)


def content(rows, end):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow(["id", "a", "b"])
    w.writerows(rows)
    return out.getvalue()


TEXTS = ["", "x", " y ", "two\nlines", "\n", "\n\nthree\n", 'a "quoted" word', '"', '""\n""', "comma, comma", "é\U0001f600\n ", "long " * 60 + "\n" + "more " * 40, "\r\nx", "tab\t", "\\N", "ends with \\"]


@pytest.mark.parametrize(("end", "size"), [("\n", 40), ("\r\n", 333), ("\n", 5000)])
def test_ranges_hold_what_the_file_holds(spark, tmp_path, small_ranges, size, end, monkeypatch):
    rng = random.Random(size)
    rows = [(i, rng.choice(TEXTS), rng.choice(TEXTS)) for i in range(120)]
    for k in (1, 2):
        (tmp_path / f"{k}.csv").write_bytes(content(rows[:100] if k == 1 else rows[100:], end).encode())
    small_ranges(size)
    fields = [("id", T.IntegerType()), ("a", T.StringType()), ("b", T.StringType())]
    want = sorted((i, *(None if x == "\\N" else x for x in (a, b))) for i, a, b in rows)
    for sent in (splits.SENT_RANGES, -1):
        monkeypatch.setattr(splits, "SENT_RANGES", sent)
        got = files.read_csv(spark, str(tmp_path), fields, split=True, place="at")
        found = got.collect()
        key = lambda r: (r[0], *map(str, r[1:]))
        assert sorted(((r["id"], r["a"], r["b"]) for r in found), key=key) == sorted(want, key=key)
        assert [r["id"] for r in sorted(found, key=lambda r: r["at"])] == list(range(120))
    many = splits.lines(spark, str(tmp_path)).select("file", "block").distinct().count()
    assert many > (20 if size == 40 else 1)
    with pytest.raises(ValueError, match="header"):
        files.read_csv(spark, str(tmp_path), fields[::-1], split=True)


def test_rows_of_another_width_fail(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,a\n1,x\n2\n")
    with pytest.raises(Exception, match="MALFORMED"):
        files.read_csv(spark, str(tmp_path / "t.csv"), [("id", T.IntegerType()), ("a", T.StringType())], split=True).collect()
    (tmp_path / "e.csv").write_text("id,a\n")
    assert files.read_csv(spark, str(tmp_path / "e.csv"), [("id", T.IntegerType()), ("a", T.StringType())], split=True).count() == 0


@pytest.mark.parametrize("split", [False, True])
def test_written_values_come_back_as_they_were(spark, tmp_path, split):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if t != "\\N"] + [(99, None)], "id int, a string")
    files.write_csv(df, str(tmp_path / "t.csv"))
    got = files.read_csv(spark, str(tmp_path / "t.csv"), [("id", T.IntegerType()), ("a", T.StringType())], split=split)
    # Spark's own reader takes any line end in a field for one line feed.
    same = (lambda t: t) if split else (lambda t: t and t.replace("\r\n", "\n"))
    assert {r["id"]: same(r["a"]) for r in got.collect()} == {r["id"]: same(r["a"]) for r in df.collect()}
    files.write_csv(df.select("a"), str(tmp_path / "one.csv"))
    assert files.read_csv(spark, str(tmp_path / "one.csv"), [("a", T.StringType())], split=split).count() == df.count()


def test_one_file_is_made_by_many_tasks(spark, tmp_path):
    df = spark.range(0, 4000, 1, 6).select("id", F.array(*map(F.lit, TEXTS[:14]))[(F.col("id") % 14).cast("int")].alias("a, b"))
    df = df.withColumn("task", F.spark_partition_id())
    files.write_csv_file(df, str(tmp_path / "t.csv"))
    assert len(list((tmp_path / "t.csv").glob("part-*"))) == 1
    fields = [("id", T.LongType()), ("a, b", T.StringType()), ("task", T.IntegerType())]
    got = files.read_csv(spark, str(tmp_path / "t.csv"), fields, split=True, place="at").orderBy("at").drop("at").collect()
    assert got == df.collect() and {r["task"] for r in got} == set(range(6))


def test_a_file_is_cut_in_two_passes(spark, tmp_path, small_ranges, monkeypatch):
    """One pass for what crosses ranges and for headers, one for all other records: no task returns the rest twice."""
    (tmp_path / "t.csv").write_bytes(content([(i, "x\ny", "z") for i in range(500)], "\n").encode())
    small_ranges(700)
    passed, real = [], splits.staged
    monkeypatch.setattr(splits, "staged", lambda df, label: (passed.append((label, real(df, label))), passed[-1][1])[1])
    few, rest = splits.records(spark, str(tmp_path / "t.csv"))
    pieces = dict(passed)["pieces"]
    ranges = dict(passed)["ranges"].count()
    assert ranges > 5 and pieces.count() <= 2 * ranges + 1 and few.filter("block = 0 AND seq = 0").collect()[0]["record"] == "id,a,b"
    assert few.count() + rest.count() == 501 and rest.filter("block = 0 AND seq = 0").count() == 0


KEYED = Catalog("c", [Table("t", [Column("k", "INT"), Column("v", "TEXT")], [Constraint(PRIMARY_KEY, ["k"])]), Table("bare", [Column("v", "TEXT")])])


def test_the_last_row_of_a_key_stays(spark, tmp_path):
    (tmp_path / "01_t.csv").write_text("k,v\n1,z\n2,y\n1,a\n\\N,n\n\\N,n\n3,q\n")
    (tmp_path / "02_main.t.csv").write_text("k,v\n2,b\n4,\\N\n2,\n")
    (tmp_path / "bare.csv").write_text("v\nx\nx\n")
    (tmp_path / "notes.txt").write_text("no table")
    for split in (False, True):
        got = files.load_folder(spark, str(tmp_path), KEYED, split=split)
        assert sorted((r["k"] or 0, r["v"]) for r in got["t"].filter("v IS NOT NULL").collect()) == [(0, "n"), (0, "n"), (1, "a"), (2, ""), (3, "q")]
        assert got["t"].filter("v IS NULL").count() == 1 and got["bare"].count() == 2
    one = files.load_any(spark, str(tmp_path / "01_t.csv"), KEYED)["t"]
    assert {r["k"]: r["v"] for r in one.collect()}[1] == "a"


def test_dumps_follow_the_key(spark, tmp_path):
    df = spark.range(1000, 0, -1).select(F.col("id").cast("int").alias("k"), F.lit("v").alias("v")).repartition(5)
    files.dump({"t": df, "bare": df.select("v")}, KEYED, str(tmp_path / "d"))
    text = spark.read.text(str(tmp_path / "d" / "t.csv")).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i")).collect()
    keys = [int(r["value"].split(",")[0]) for r in sorted(text, key=lambda r: (r["f"], r["i"])) if r["value"] != "k,v"]
    assert keys == list(range(1, 1001))
    catalog, back = files.load(spark, str(tmp_path / "d"))
    assert catalog == KEYED and back["t"].count() == 1000 and back["bare"].count() == 1000


def test_jobs_side_by_side(spark):
    both = threading.Barrier(2, timeout=60)
    files.side_by_side(spark, {"a": both.wait, "b": both.wait}, width=2)  # one after the other they would wait for ever
    ran = []

    def slow():
        time.sleep(2)
        ran.append("slow")

    def fails():
        raise ZeroDivisionError

    with pytest.raises(ZeroDivisionError):
        files.side_by_side(spark, {"fails": fails, "slow": slow, **{f"later{i}": lambda i=i: ran.append(i) for i in range(3)}}, width=1)
    assert set(ran) <= {"slow"}  # which may have begun


def test_time_stamps_with_and_without_offsets(spark):
    cases = {"2024-03-10 02:30:00": "2024-03-10 02:30:00", "2024-03-10T02:30Z": "2024-03-10 02:30:00", "2024-03-10 02:30:00.5+01:30": "2024-03-10 01:00:00.500000", "2024-03-10T02:30:00-08:00": "2024-03-10 10:30:00", "2024-03-10": "2024-03-10 00:00:00", "": None}
    for zone in ("UTC", "America/New_York"):
        before = spark.conf.get("spark.sql.session.timeZone")
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", codec.parse_timestamp(F.col("t")).cast("string").alias("p")).collect()
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)
        assert {r["t"]: r["p"] and r["p"].ljust(19)[:26] for r in got} == {k: v and (v if "." not in v else v.rstrip("0")) for k, v in cases.items()}


ZONED = ("customer_balance", "epoch_timestamps", "parse_timestamp_formats", "csv_encode_orders", "csv_decode_orders", "dump_and_load", "exclusion_overlapping_orders", "stamp_changed_customers")


def test_queries_of_time_stamps_are_the_same_in_any_zone(spark, small):
    import __spark_entry__ as entry

    known, before = entry.queries(), spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ZONED:
            found = []
            for zone in ("UTC", "America/New_York"):
                spark.conf.set("spark.sql.session.timeZone", zone)
                df = known[name](spark, small)
                found.append(sorted(map(repr, df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).collect())))
            assert found[0] == found[1], name
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
