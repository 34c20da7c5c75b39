"""Exclusion constraints, bands and referential actions against plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from relweave.catalog import CASCADE, EXCLUDE, FOREIGN_KEY, NO_ACTION, PRIMARY_KEY, RESTRICT, SET_DEFAULT, SET_NULL, Catalog, Column, Constraint, Table
from relweave.operators import actions, bands, exclusion, integrity

# --- bands


def test_numbers_are_gapless_and_follow_the_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, 3]), i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v int")
    got = bands.numbered(df, ["k", F.col("v").desc()], "n").collect()
    assert sorted(r["n"] for r in got) == list(range(1, 501))
    assert [(r["k"], r["v"]) for r in sorted(got, key=lambda r: r["n"])] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -r[1]))
    assert bands.numbered(df.limit(0), ["k"], "n").count() == 0
    # A key of all rows fills more than one band.
    assert bands.banded(spark.range(4000).select(F.lit(1).alias("k")), ["k"]).select("_band").distinct().count() > 1


# --- exclusion


@pytest.mark.parametrize("closed", [False, True])
def test_overlaps_against_all_pairs(spark, closed):
    rng = random.Random(7)
    rows = []
    for i in range(700):
        start = rng.choice([None, *range(400)]) if rng.random() < 0.05 else rng.randrange(4000)
        end = None if rng.random() < 0.02 else (start or 0) + rng.choice([-3, 0, 0, 1, 2, 9])
        rows.append((i, rng.choice(["hot"] * 6 + ["a", "b", None]), start, end))
    rows += [(1000, "twice", 5, 6), (1001, "twice", 5, 6), (1002, "alone", 5, 6), (1003, "touch", 1, 2), (1004, "touch", 2, 3)]
    df = spark.createDataFrame(rows, "id int, k string, s int, e int").repartition(6)
    inf = float("inf")
    span = lambda r: (-inf if r[2] is None else r[2], inf if r[3] is None else r[3])
    full = lambda x: x[0] <= x[1] if closed else x[0] < x[1]

    def meet(x, y):
        (a, b), (c, d) = span(x), span(y)
        return full((a, b)) and full((c, d)) and (a <= d and c <= b if closed else a < d and c < b)

    live = [r for r in rows if r[1] is not None]
    want = sorted(x[0] for x in live if any(x[0] != y[0] and x[1] == y[1] and meet(x, y) for y in live))
    got = exclusion.overlaps(df, ["k"], "s", "e", closed=closed)
    assert sorted(r["id"] for r in got.collect()) == want and want
    # Without keys all rows stand in one line of time.
    want = sorted(x[0] for x in rows if x[0] % 7 == 0 and any(x[0] != y[0] and y[0] % 7 == 0 and meet(x, y) for y in rows))
    assert sorted(r["id"] for r in exclusion.overlaps(df, [], "s", "e", closed=closed, predicate="id % 7 = 0").collect()) == want
    assert exclusion.overlaps(df.limit(0), ["k"], "s", "e").count() == 0


def test_exclusion_constraints(spark):
    df = spark.createDataFrame([(1, "a", 1, 5), (2, "a", 4, 6), (3, "b", 4, 6), (4, "b", 6, 7), (5, None, 1, 9), (6, None, 1, 9)], "id int, k string, s int, e int")
    spans = Constraint(EXCLUDE, ["k", "s", "e"], "spans", operators=["=", "&&", "&&"])
    same = Constraint(EXCLUDE, ["k"], "same", operators=["="], predicate="id > 2")
    assert [sorted(r["id"] for r in exclusion.violations(df, c).collect()) for c in (spans, same)] == [[1, 2], [3, 4]]
    catalog = Catalog("c", [Table("t", [Column(c, "INT") for c in df.columns], [spans, same])])
    assert Catalog.from_json(catalog.to_json()) == catalog
    assert sorted(tuple(r) for r in integrity.validate({"t": df}, catalog).collect()) == [("t", "same", "EXCLUDE", 2), ("t", "spans", "EXCLUDE", 2)]
    with pytest.raises(ValueError):
        exclusion.violations(df, Constraint(EXCLUDE, ["k", "s"], "odd", operators=["=", "<>"]))


# --- referential actions


def people(rule, update=NO_ACTION):
    """Employees with a boss, whatever the rule; cars of employees; a fleet of cars by both of its key's columns."""
    fk = lambda columns, table, refs, d, u: Constraint(FOREIGN_KEY, columns, references_table=table, references_columns=refs, delete_rule=d, update_rule=u)
    return Catalog(
        "people",
        [
            Table("person", [Column("id", "INT"), Column("boss", "INT", default="9")], [Constraint(PRIMARY_KEY, ["id"]), fk(["boss"], "person", ["id"], rule, update)]),
            Table("car", [Column("owner", "INT"), Column("no", "INT")], [Constraint(PRIMARY_KEY, ["owner", "no"]), fk(["owner"], "person", ["id"], CASCADE, CASCADE)]),
            Table("trip", [Column("o", "INT"), Column("n", "INT"), Column("km", "INT")], [fk(["o", "n"], "car", ["owner", "no"], SET_NULL, CASCADE)]),
        ],
    )


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "person": spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 6), (6, 5), (7, 7), (8, 1), (9, None)], "id int, boss int"),
        "car": spark.createDataFrame([(2, 1), (2, 2), (3, 1), (6, 1), (9, 1)], "owner int, no int"),
        "trip": spark.createDataFrame([(2, 1, 10), (2, 1, 10), (3, 1, 11), (None, 1, 12), (2, None, 13), (9, 1, 14)], "o int, n int, km int"),
    }


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is None, x or 0) for x in r])


def test_cascading_deletes_follow_cycles(spark, tables):
    out = actions.delete(tables, people(CASCADE), {"person": tables["person"].filter("id IN (2, 5, 7)")})
    assert rows(out.tables["person"]) == [(1, None), (8, 1), (9, None)]
    assert rows(out.tables["car"]) == [(9, 1)]
    # Of a key of two columns both are emptied; what refers to nothing stays.
    assert rows(out.tables["trip"]) == rows(spark.createDataFrame([(None, None, 10), (None, None, 10), (None, None, 11), (None, 1, 12), (2, None, 13), (9, 1, 14)], "o int, n int, km int"))
    assert out.blocked.count() == 0
    nothing = actions.delete(tables, people(CASCADE), {"person": tables["person"].limit(0)})
    assert all(rows(nothing.tables[n]) == rows(tables[n]) for n in tables)


def test_other_delete_rules(tables):
    seeds = {"person": tables["person"].filter("id IN (1, 2, 5)")}
    said = lambda out: sorted((r["table"], r["rule"], *json.loads(r["row"]).values()) for r in out.blocked.collect())
    out = actions.delete(tables, people(SET_NULL), seeds)
    assert rows(out.tables["person"]) == [(3, None), (4, 3), (6, None), (7, 7), (8, None), (9, None)] and said(out) == []
    out = actions.delete(tables, people(SET_DEFAULT), seeds)
    assert rows(out.tables["person"]) == [(3, 9), (4, 3), (6, 9), (7, 7), (8, 9), (9, None)] and said(out) == []
    out = actions.delete(tables, people(SET_DEFAULT), {"person": tables["person"].filter("id IN (1, 9)")})
    assert said(out) == [("person", "SET DEFAULT", 2), ("person", "SET DEFAULT", 8)]
    # 2 goes itself, so that it may reference 1; 3, 6 and 8 stay.
    for rule in (NO_ACTION, RESTRICT):
        assert said(actions.delete(tables, people(rule), seeds)) == [("person", rule, 3), ("person", rule, 6), ("person", rule, 8)]


def test_restrict_holds_against_rows_that_a_cascade_takes_along(spark, tables):
    catalog = people(NO_ACTION)
    catalog.table("trip").constraints[0].delete_rule = CASCADE
    catalog.table("trip").constraints.append(Constraint(FOREIGN_KEY, ["o"], "trip_person", references_table="person", references_columns=["id"], delete_rule=RESTRICT))
    out = actions.delete(tables, catalog, {"person": tables["person"].filter("id IN (2, 3, 4)")})
    assert {(r["constraint"], r["rule"]) for r in out.blocked.collect()} == {("trip_person", RESTRICT)} and out.blocked.count() == 4
    catalog.table("trip").constraints[-1].delete_rule = NO_ACTION
    assert [json.loads(r["row"]) for r in actions.delete(tables, catalog, {"person": tables["person"].filter("id IN (2, 3, 4)")}).blocked.collect()] == [{"o": 2, "n": None, "km": 13}]


def test_key_updates_are_carried_on(spark, tables):
    moved = spark.createDataFrame([(2, 3), (3, 2), (6, 60), (None, 5)], "old_id int, new_id int")
    out = actions.update_key(tables, people(CASCADE, CASCADE), "person", moved)
    assert rows(out.tables["person"]) == [(1, None), (2, 3), (3, 1), (4, 2), (5, 60), (7, 7), (8, 1), (9, None), (60, 5)]
    assert rows(out.tables["car"]) == [(2, 1), (3, 1), (3, 2), (9, 1), (60, 1)]
    # The key of two columns changes in one of them, two tables on.
    assert rows(out.tables["trip"]) == [(2, 1, 11), (2, None, 13), (3, 1, 10), (3, 1, 10), (9, 1, 14), (None, 1, 12)]
    assert out.blocked.count() == 0
    said = lambda o: sorted((r["table"], r["rule"], r["row"]) for r in o.blocked.collect())
    assert said(actions.update_key(tables, people(CASCADE, RESTRICT), "person", moved)) == [("person", RESTRICT, f'{{"id":{i}}}') for i in (3, 4, 5)]
    # A swap leaves every reference with a row, a plain change doesn't.
    assert said(actions.update_key(tables, people(CASCADE, NO_ACTION), "person", moved)) == [("person", NO_ACTION, '{"id":5}')]
    assert rows(actions.update_key(tables, people(CASCADE, SET_NULL), "person", moved).tables["person"]) == [(1, None), (2, None), (3, 1), (4, None), (5, None), (7, 7), (8, 1), (9, None), (60, 5)]
    assert said(actions.update_key(tables, people(CASCADE, CASCADE), "person", spark.createDataFrame([(2, 9)], "old_id int, new_id int"))) == [("person", PRIMARY_KEY, '{"id":9}')]
    with pytest.raises(ValueError):
        actions.update_key(tables, people(CASCADE), "person", spark.createDataFrame([(2, 9), (2, 8)], "old_id int, new_id int"))
