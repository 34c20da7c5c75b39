"""Subsets, DML, integrity and CSV exchange on small relational fixtures."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.catalog import CHECK, FOREIGN_KEY, PRIMARY_KEY, UNIQUE, Catalog, Column, Constraint, Table, sample_catalog
from relweave.functions import codec
from relweave.operators import dml, integrity, subset
from relweave.queries import sample
from relweave.sources import files


def fk(column, table, target):
    return Constraint(FOREIGN_KEY, [column], references_table=table, references_columns=[target])


@pytest.fixture(scope="module")
def shop(spark):
    """A cycle (staff, store), a self-reference (staff.boss), parallel keys (film to language), a nullable key and a table without a key."""
    rows = {
        "language": ("language_id int, name string", [(1, "en"), (2, "fr"), (3, "de")]),
        "film": ("film_id int, language_id int, original_id int", [(1, 1, 2), (2, 1, None), (3, 3, 3)]),
        "staff": ("staff_id int, store_id int, boss int", [(1, 1, None), (2, 2, 1), (3, 2, 2), (4, None, 4)]),
        "store": ("store_id int, manager_id int", [(1, 1), (2, 3)]),
        "rental": ("film_id int, staff_id int", [(1, 2), (1, 2), (3, 4), (None, 1)]),
    }
    tables = {n: spark.createDataFrame(r, s) for n, (s, r) in rows.items()}
    keys = {"language": "language_id", "film": "film_id", "staff": "staff_id", "store": "store_id"}
    fks = {"film": [fk("language_id", "language", "language_id"), fk("original_id", "language", "language_id")], "staff": [fk("store_id", "store", "store_id"), fk("boss", "staff", "staff_id")], "store": [fk("manager_id", "staff", "staff_id")], "rental": [fk("film_id", "film", "film_id"), fk("staff_id", "staff", "staff_id")]}
    catalog = Catalog("shop", [Table(n, [Column(f.name, "INT" if f.name != "name" else "TEXT") for f in df.schema], ([Constraint(PRIMARY_KEY, [keys[n]])] if n in keys else []) + fks.get(n, [])) for n, df in tables.items()])
    return tables, catalog


def ids(df):
    return sorted(tuple(r) for r in df.collect())


def test_upstream_follows_cycles_and_self_references(shop):
    tables, catalog = shop
    got = subset.subset(tables, catalog, {"rental": tables["rental"].filter("film_id = 1")})
    assert ids(got["rental"]) == [(1, 2), (1, 2)]
    assert ids(got["film"]) == [(1, 1, 2)] and ids(got["language"]) == [(1, "en"), (2, "fr")]
    assert [r[0] for r in ids(got["staff"])] == [1, 2, 3] and [r[0] for r in ids(got["store"])] == [1, 2]


def test_extended_subset_and_dangling_keys(shop):
    tables, catalog = shop
    got = subset.subset(tables, catalog, {"language": tables["language"].filter("language_id = 3")}, extended=True)
    assert ids(got["film"]) == [(3, 3, 3)] and ids(got["rental"]) == [(3, 4)] and [r[0] for r in ids(got["staff"])] == [4]
    for k in catalog.foreign_keys():
        if k.child in got:
            assert integrity.orphans(got[k.child], k.columns, got[k.parent], k.parent_columns).count() == 0


def test_extended_rows_without_a_key_stay_as_they_are(spark):
    """Rows that the way down found aren't searched for again by all their columns, where nulls would meet nothing."""
    rows = {"a": ("id int", [(1,), (2,)]), "b": ("id int, a int", [(1, 1), (2, 2)]), "c": ("a int, b int, text string", [(1, 2, None), (1, 2, None), (2, None, "x"), (1, None, "y"), (None, 1, None)])}
    tables = {n: spark.createDataFrame(r, s) for n, (s, r) in rows.items()}
    key = Constraint(PRIMARY_KEY, ["id"])
    columns = {"a": ["id"], "b": ["id", "a"], "c": ["a", "b", "text"]}
    keys = {"a": [key], "b": [key, fk("a", "a", "id")], "c": [fk("a", "a", "id"), fk("b", "b", "id")]}
    catalog = Catalog("abc", [Table(n, [Column(c, "TEXT" if c == "text" else "INT") for c in columns[n]], keys[n]) for n in columns])
    got = subset.subset(tables, catalog, {"a": tables["a"].filter("id = 1")}, extended=True)
    assert sorted(map(repr, map(tuple, got["c"].collect()))) == sorted(map(repr, [(1, 2, None), (1, 2, None), (1, None, "y"), (None, 1, None)]))
    assert ids(got["b"]) == [(1, 1), (2, 2)] and ids(got["a"]) == [(1,), (2,)]


def test_path_limited_subset_leaves_out_cycles(shop):
    tables, catalog = shop
    got = subset.subset(tables, catalog, {"staff": tables["staff"].filter("staff_id = 3")}, paths=True)
    assert [r[0] for r in ids(got["staff"])] == [3]


def test_empty_seeds_and_unknown_tables(shop):
    tables, catalog = shop
    got = subset.subset(tables, catalog, {"film": tables["film"].limit(0)})
    assert all(df.count() == 0 for df in got.values())
    with pytest.raises(KeyError):
        subset.subset(tables, catalog, {"nowhere": tables["film"]})
    with pytest.raises(ValueError, match="which the catalog"):
        Catalog("x", [Table("a", [Column("b", "INT")], [fk("b", "gone", "b")])]).foreign_keys()


def test_seed_templates(spark, shop):
    tables, catalog = shop
    name, rows = subset.seed(spark, "SELECT {*} FROM {film} WHERE '{{' <> '' ORDER BY film_id LIMIT 2", tables, catalog)
    assert name == "film" and ids(rows) == [(1,), (2,)]
    for bad in ("SELECT * FROM {film}", "SELECT {*} FROM film", "SELECT {*} FROM {film} {", "SELECT {*}, {*} FROM {film}", "SELECT {*} FROM {film}, {staff}", "SELECT {*} FROM {rental}"):
        with pytest.raises(ValueError):
            subset.seed(spark, bad, tables, catalog)


def test_acceptance_counts_on_the_sample_tables(spark):
    tables = sample(spark, "/root/testdata/sf0.01")
    catalog = sample_catalog()
    top = tables["orders"].orderBy("o_orderkey").limit(10)
    up = subset.subset(tables, catalog, {"orders": top})
    assert {n: df.count() for n, df in up.items()} == {"orders": 10, "customer": 10, "nation": 8, "region": 4}
    nation = subset.subset(tables, catalog, {"nation": tables["nation"].filter("n_nationkey < 1")}, extended=True)
    assert {n: df.count() for n, df in nation.items()} == {"nation": 25, "customer": 802, "supplier": 100, "orders": 1588, "lineitem": 3273, "events": 254, "part": 1623, "region": 5}


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (None, "n", 3.0)], "k int, s string, v double")
    sent = spark.createDataFrame([(2, "x", 0), (2, None, 1), (3, "new", 0), (None, "lost", 9)], "k int, s string, at int")
    assert ids(dml.upsert(target, sent, ["k"], "at").na.fill(-1).na.fill("-")) == [(-1, "n", 3.0), (1, "a", 1.0), (2, "-", 2.0), (3, "new", -1.0)]
    whole = spark.createDataFrame([(2, "y", 9.0), (4, "z", 8.0)], "k int, s string, v double")
    assert ids(dml.upsert(target.dropna(), whole, ["k"])) == [(1, "a", 1.0), (2, "y", 9.0), (4, "z", 8.0)]
    assert ids(dml.upsert(target.dropna(), whole.select("k"), ["k"]).select("k")) == [(1,), (2,), (4,)]
    assert ids(dml.update_from(target.dropna(), whole, ["k"])) == [(1, "a", 1.0), (2, "y", 9.0)]
    assert ids(dml.upsert(target.dropna(), whole.limit(0), ["k"])) == [(1, "a", 1.0), (2, "b", 2.0)]
    with pytest.raises(ValueError):
        dml.upsert(target, whole.withColumn("more", F.lit(1)), ["k"])


def test_other_dml(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, s string")
    assert len(dml.delete_in(target, "k", [1]).collect()) == 2
    assert ids(dml.rename_key(target.dropna(), "k", 1, 7)) == [(2, "b"), (7, "a")]
    with pytest.raises(ValueError):
        dml.rename_key(target, "k", 1, 2)
    assert dml.next_identity(target, "k") == 3 and dml.next_identity(target.limit(0), "k") == 1
    assert dml.copy_common(target, ["x", "s"]).columns == ["s"]


def test_integrity(spark):
    a = spark.createDataFrame([(1, 1), (1, 2), (None, 3), (None, 3)], "k int, v int")
    assert ids(integrity.duplicates(a, ["k"])) == [(1, 2)]
    assert ids(integrity.nulls(a, ["k", "v"])) == [("k", 2)] and integrity.nulls(a, []).count() == 0
    assert ids(integrity.check_failures(a, "k + v < 3")) == [(1, 2)]
    catalog = Catalog("c", [Table("a", [Column("k", "INT", not_null=True), Column("v", "INT")], [Constraint(PRIMARY_KEY, ["k"]), Constraint(UNIQUE, ["v"]), Constraint(CHECK, ["v"], check="v < 3")])])
    got = {tuple(r)[1:] for r in integrity.validate({"a": a}, catalog).collect()}
    assert got == {("a_k_pkey", "PRIMARY KEY", 2), ("a_v_key", "UNIQUE", 2), ("a_v_check", "CHECK", 2), ("a_k_not_null", "NOT NULL", 2)}
    assert integrity.validate({"a": a.filter("v = 1")}, catalog).count() == 0


VALUES = [
    (1, "plain", True, 1.0, decimal.Decimal("1.50"), b"\x00\xff", datetime.datetime(2024, 1, 2, 3, 4, 5, 678), [1, None]),
    (2, "", False, -0.1, None, None, None, None),
    (3, 'quote " and, comma', None, 1e21, decimal.Decimal("-2.00"), b"x", datetime.datetime(1999, 12, 31), []),
    (4, "line\nfeed \\N inside", True, 1.5e-7, decimal.Decimal("0.00"), b"", datetime.datetime(2000, 1, 1), [3]),
    (5, None, None, None, None, None, None, None),
    (6, "é ñ ü \\", True, 123456789.125, None, None, None, None),
]
SCHEMA = "id int, s string, b boolean, d double, m decimal(10,2), raw binary, t timestamp_ntz, l array<int>"


def test_csv_fields_and_round_trip(spark, tmp_path):
    df = spark.createDataFrame(VALUES, SCHEMA)
    fields = [tuple(r) for r in files.encoded(df).orderBy("id").collect()]
    assert fields[0] == ("1", "plain", "1", "1", "1.50", "0x00ff", "2024-01-02 03:04:05", "[1,null]")
    assert fields[1] == ("2", "", "0", "-0.1", "\\N", "\\N", "\\N", "\\N")
    assert fields[2][3] == "1000000000000000000000" and fields[3][3] == "0.00000015" and fields[5][3] == "123456789.125" and fields[3][5] == "\\N"
    files.write_csv(df.repartition(3), f"{tmp_path}/t.csv")
    back = files.read_csv(spark, f"{tmp_path}/t.csv", [(f.name, f.dataType) for f in df.schema])
    want = {r[0]: r[:5] + (r[5] or None, r[6].replace(microsecond=0) if r[6] else None, r[7]) for r in VALUES}
    assert {r["id"]: tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in back.collect()} == want


def test_ragged_rows_wrong_headers_and_bad_values_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3\n")
    (tmp_path / "b.csv").write_text("y,x\n1,2\n")
    (tmp_path / "c.csv").write_text("x,y\n1,zz\n")
    for name in "abc":
        with pytest.raises(Exception):  # noqa: B017
            files.read_csv(spark, f"{tmp_path}/{name}.csv", [("x", T.IntegerType()), ("y", T.IntegerType())]).collect()
    for text, kind in (("0xzz", T.BinaryType()), ("yesterday", T.TimestampNTZType())):
        with pytest.raises(Exception):  # noqa: B017
            spark.createDataFrame([(text,)], "x string").select(codec.decode(F.col("x"), kind)).collect()


def test_timestamps_and_uuids(spark):
    texts = {"2024-01-02 03:04:05.5+02:00": "2024-01-02 01:04:05.5", "2024-01-02T03:04": "2024-01-02 03:04:00", "2024-01-02": "2024-01-02 00:00:00", "2024-01-02T03:04:05Z": "2024-01-02 03:04:05", "": None, None: None}
    df = spark.createDataFrame([(k, v) for k, v in texts.items()], "x string, want string")
    assert df.filter(~codec.parse_timestamp(F.col("x")).eqNullSafe(F.col("want").cast("timestamp_ntz"))).count() == 0
    n = spark.createDataFrame([(1_700_000_000,), (1_700_000_000_000,)], "n bigint").select(codec.epoch_timestamp(F.col("n"))).distinct()
    assert n.count() == 1
    raw = spark.createDataFrame([(bytes(range(16)),)], "r binary")
    text = raw.select(codec.uuid_from_bytes(F.col("r")).alias("u"), codec.uuid_to_bytes(codec.uuid_from_bytes(F.col("r"))).alias("r")).first()
    assert text["u"] == "00010203-0405-0607-0809-0a0b0c0d0e0f" and bytes(text["r"]) == bytes(range(16))
    with pytest.raises(Exception):  # noqa: B017
        spark.createDataFrame([(b"short",)], "r binary").select(codec.uuid_from_bytes(F.col("r"))).collect()


def test_dump_and_load(spark, tmp_path, small):
    tables, catalog = sample(spark, small), sample_catalog()
    tables = {n: tables[n] for n in ("region", "nation", "orders")}
    catalog.tables = [t for t in catalog.tables if t.name in tables]
    files.dump(tables, catalog, f"{tmp_path}/dump", compression="gzip")
    again, loaded = files.load(spark, f"{tmp_path}/dump")
    assert again == catalog
    for n, df in tables.items():
        want = df.withColumn("o_orderdate", F.date_trunc("second", "o_orderdate").cast("timestamp_ntz")) if n == "orders" else df
        assert loaded[n].schema.simpleString() == want.schema.simpleString() and loaded[n].exceptAll(want).count() == 0 == want.exceptAll(loaded[n]).count()


def test_file_names_and_addresses():
    assert files.table_name("01_a.csv") == ("", "a") and files.table_name("02_main.b.csv") == ("main", "b") and files.table_name("_t.csv") == ("", "_t")
    with pytest.raises(ValueError):
        files.table_name("t.txt")
    assert files.jdbc_url("postgres://u:p@h:5432/db") == ("postgres", "jdbc:postgresql://h:5432/db") and files.jdbc_url("x.db") == ("sqlite", "jdbc:sqlite:x.db")
    for bad in ("nothing", "ftp://x"):
        with pytest.raises(ValueError):
            files.jdbc_url(bad)


def test_lazy_quotes(spark, tmp_path):
    """Quotes inside a field that aren't doubled are quotes."""
    fields = [("a", T.StringType()), ("b", T.StringType())]
    for i, (line, want) in enumerate([('x"y,2', ('x"y', "2")), ('"x"y",2', ('x"y', "2")), ('"x""y",2', ('x"y', "2")), ('"l1\nl2",""', ("l1\nl2", "")), ('x,"a, ""b"""', ("x", 'a, "b"'))]):
        path = tmp_path / f"{i}.csv"
        path.write_text(f"a,b\n{line}\n")
        assert [tuple(r) for r in files.read_csv(spark, str(path), fields).collect()] == [want], line


def test_folders_of_named_files_and_dispatch_by_suffix(spark, tmp_path, small):
    catalog = sample_catalog()
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "01_region.csv").write_text("r_regionkey,r_name\n1,one\n2,two\n")
    (folder / "02_main.region.csv").write_text("r_regionkey,r_name\n2,zwei\n3,drei\n")
    (folder / "notes.txt").write_text("no table")
    files.write_csv(spark.read.parquet(f"{small}/nation.parquet"), str(folder / "nation.csv"))
    found = files.load_any(spark, str(folder), catalog)
    assert list(found) == ["region", "nation"] and sorted(tuple(r) for r in found["region"].collect()) == [(1, "one"), (2, "zwei"), (3, "drei")]
    assert found["nation"].exceptAll(spark.read.parquet(f"{small}/nation.parquet")).count() == 0 and found["nation"].count() == spark.read.parquet(f"{small}/nation.parquet").count()
    assert files.load_any(spark, str(folder / "01_region.csv"), catalog)["region"].count() == 2
    (folder / "run.sql").write_text("SELECT 1;")
    assert files.load_any(spark, str(folder / "run.sql"))["run.sql"].first()["success"]
    (folder / "strange.csv").write_text("a\n1\n")
    with pytest.raises(KeyError, match="strange"):
        files.load_any(spark, str(folder), catalog)
    for bad in ("x.zip", "x.tar.gz", "region.csv"):
        with pytest.raises(ValueError, match="archive|catalog"):
            files.load_any(spark, str(folder / bad))
    files.dump({"region": found["region"]}, Catalog("c", [catalog.table("region")]), str(tmp_path / "dump"))
    assert files.load_any(spark, str(tmp_path / "dump"))["region"].count() == 3


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """A table that references itself, as a chain, a ring, a tree and a row that is its own parent."""
    from relweave.catalog import FOREIGN_KEY, PRIMARY_KEY, Catalog, Column, Constraint, Table

    catalog = Catalog("c", [Table("t", [Column("id", "INT"), Column("up", "INT")], [Constraint(PRIMARY_KEY, ["id"]), Constraint(FOREIGN_KEY, ["up"], references_table="t", references_columns=["id"])])])
    parent = {i: i - 1 for i in range(1, 1001)} | {0: None} | {2000: 2004, **{i: i - 1 for i in range(2001, 2005)}} | {i: (i - 3000) // 2 + 2999 if i > 3000 else None for i in range(3000, 3040)} | {5000: 5000, 6000: 9999}
    t = spark.createDataFrame(list(parent.items()), "id int, up int")
    rounds = []
    real = subset.staged
    monkeypatch.setattr(subset, "staged", lambda df, label: (rounds.append(label), real(df, label))[1])
    for seeds in ([1000], [2002, 3037, 0, 5000, 6000], []):
        up, todo = set(seeds), list(seeds)
        while todo:
            p = parent[todo.pop()]
            if p in parent and p not in up:
                up.add(p)
                todo.append(p)
        down = set(seeds)
        while more := {i for i, p in parent.items() if p in down} - down:
            down |= more
        rows = {"t": t.filter(F.col("id").isin(seeds))}
        rounds.clear()
        assert {r["id"] for r in subset.closure({"t": t}, catalog, rows, down=False)["t"].collect()} == up
        assert {r["id"] for r in subset.closure({"t": t}, catalog, rows, down=True)["t"].collect()} == down
        assert rounds.count("reached") <= 2 * 12 + 2


def test_a_long_chain_passes_few_pointers(spark, monkeypatch):
    """Large tables that reference themselves are made smaller first: all rounds together pass a few times the table, and reach the same."""
    catalog = Catalog("c", [Table("t", [Column("id", "BIGINT"), Column("up", "INT")], [Constraint(PRIMARY_KEY, ["id"]), fk("up", "t", "id")])])
    parent = {i: i - 1 for i in range(1, 1001)} | {0: None} | {2000: 2004, **{i: i - 1 for i in range(2001, 2005)}} | {i: (i - 3000) // 2 + 2999 if i > 3000 else None for i in range(3000, 3040)} | {5000: 5000, 6000: 9999, 7000: 7001, 7001: 7000}
    t = spark.createDataFrame(list(parent.items()), "id bigint, up int").repartition(2)
    passed, real = [], subset.staged
    monkeypatch.setattr(subset, "staged", lambda df, label: (passed.append((label, real(df, label))), passed[-1][1])[1])
    monkeypatch.setattr(subset, "SPLICED_ROWS", 300)
    for seeds in ([500, 2002, 3037, 3007, 5000, 6000, 7001],):
        up, todo = set(seeds), list(seeds)
        while todo:
            p = parent[todo.pop()]
            if p in parent and p not in up:
                up.add(p)
                todo.append(p)
        down = set(seeds)
        while more := {i for i, p in parent.items() if p in down} - down:
            down |= more
        rows = {"t": t.filter(F.col("id").isin(seeds))}
        for way, want in ((False, up), (True, down)):
            passed.clear()
            got = [r["id"] for r in subset.closure({"t": t}, catalog, rows, down=way)["t"].collect()]
            assert sorted(got) == sorted(want)
        assert sum(df.count() for label, df in passed if label in ("hops", "spliced")) < 6 * len(parent)


def test_collations_by_name():
    from relweave.functions.collation import spark_collation

    names = {"NOCASE": "UTF8_LCASE", "C": "UTF8_BINARY", "en_US.utf8": "UTF8_BINARY", "de-x-icu": "UTF8_BINARY", "utf8mb4_0900_ai_ci": "UNICODE_CI_AI", "utf8mb4_0900_as_ci": "UNICODE_CI", "utf8mb4_general_ci": "UNICODE_CI_AI", "utf8mb4_bin": "UTF8_BINARY", "utf8mb4_0900_as_cs": "UNICODE", "SQL_Latin1_General_CP1_CI_AS": "UNICODE_CI", "Latin1_General_100_CI_AI_SC": "UNICODE_CI_AI", "Latin1_General_CS_AI": "UNICODE_AI", "Latin1_General_BIN2": "UTF8_BINARY", "UTF8_LCASE": "UTF8_LCASE"}
    assert {n: spark_collation(n) for n in names} == names


def test_keys_follow_their_collation(spark):
    from relweave.functions.collation import collated, plain

    t = Table("t", [Column("k", "TEXT", collation="NOCASE"), Column("v", "INT")], [Constraint(PRIMARY_KEY, ["k"])])
    target = spark.createDataFrame([("Ann", 1), ("bob", 2), (None, 3)], "k string, v int")
    sent = spark.createDataFrame([("ANN", 10, 1), ("ann", 11, 2), ("EVE", 12, 1)], "k string, v int, at int")
    out = plain(dml.upsert(collated(target, t), collated(sent, t), ["k"], "at"))
    assert out.schema == target.schema and sorted(tuple(r) for r in out.dropna().collect()) == [("EVE", 12), ("ann", 11), ("bob", 2)] and out.count() == 4
    twice = target.unionByName(spark.createDataFrame([("ANN", 5)], "k string, v int"))
    assert [tuple(r) for r in integrity.validate({"t": twice}, Catalog("c", [t])).collect()] == [("t", "t_pkey", "PRIMARY KEY", 2)]
    t.columns[0].collation = ""
    assert integrity.validate({"t": twice}, Catalog("c", [t])).count() == 0
