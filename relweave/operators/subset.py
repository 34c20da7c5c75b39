"""Referentially intact subsets.

Seed rows are closed over the foreign-key graph: upstream (rows that included
rows reference) or extended (first downstream, rows that reference included
rows, then upstream of all of them). Every step is a semi-join on the key
columns alone. An acyclic graph is one pass in topological order, in which the
keys of a table that several references leave from are staged, and downwards
all keys, so that no path to it is computed twice; tables that reach each other through a cycle are
iterated on staged keys, each round from the keys that the last one brought.

`paths=True` follows the older, path-limited rule instead: each foreign key is
visited once and no table twice on one path, so a table reached late may not be
followed further, and cycles aren't.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.catalog import Catalog, ForeignKey, strongly_connected
from relweave.sources.staging import staged

Tables = Mapping[str, DataFrame]


def _keyed(df: DataFrame, columns, names) -> DataFrame:
    return df.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)])


def _hits(fk: ForeignKey, source: DataFrame, down: bool) -> tuple[tuple[str, ...], DataFrame]:
    """Key columns of the table to extend, and the values of them that `source` brings."""
    mine, theirs = (fk.columns, fk.parent_columns) if down else (fk.parent_columns, fk.columns)
    return mine, _keyed(source, theirs, mine)


def _any(table: DataFrame, conditions: list[tuple[tuple[str, ...], DataFrame]]) -> DataFrame:
    """Rows of table that meet one of the key sets or more, each row once and none twice. Nulls meet nothing.

    Key sets of the same columns are one set, and one semi-join; only several
    kinds of columns need marks, one join each.
    """
    by: dict[tuple[str, ...], DataFrame] = {}
    for columns, keys in conditions:
        by[columns] = by[columns].unionByName(keys) if columns in by else keys
    if len(by) == 1:
        (columns, keys), = by.items()
        return table.join(keys, list(columns), "left_semi").select(table.columns)
    out, marks = table, []
    for i, (columns, keys) in enumerate(by.items()):
        mark = f"_hit{i}"
        marks.append(F.col(mark).isNotNull())
        renamed = _keyed(keys, columns, [f"_key{i}_{c}" for c in columns]).distinct().withColumn(mark, F.lit(True))
        on = [F.col(c) == F.col(f"_key{i}_{c}") for c in columns]
        out = out.join(renamed, on, "left").drop(*[f"_key{i}_{c}" for c in columns])
    hit = marks[0]
    for m in marks[1:]:
        hit = hit | m
    return out.filter(hit).select(table.columns)


def closure(tables: Tables, catalog: Catalog, start: Mapping[str, DataFrame], down: bool, follow: Callable[[ForeignKey], bool] = lambda _: True, own: bool = False) -> dict[str, DataFrame]:
    """Rows reached from `start` by the foreign keys that are followed: up to what rows reference, or down to what references them.

    own: the rows of start are the tables' own, each as often as there, so that a table that nothing else reaches needn't be searched for them.
    """
    fks = [k for k in catalog.foreign_keys() if k.child in tables and k.parent in tables and follow(k)]
    ends = [(k, *((k.parent, k.child) if down else (k.child, k.parent))) for k in fks]
    have: dict[str, DataFrame] = {}
    leave: dict[str, DataFrame] = {}  # of each table the columns that references to further tables need
    for group in strongly_connected(sorted(tables), [(a, b) for _, a, b in ends]):
        inner = [(k, a, b) for k, a, b in ends if a in group and b in group]
        for name in group:
            outer = [_hits(k, leave[a], down) for k, a, b in ends if b == name and a in leave and a not in group]
            if name in start and own and not outer:
                have[name] = start[name]
            elif name in start:
                outer.append(identity(catalog, name, start[name]))
            if outer:
                have[name] = _any(tables[name], outer)
        if inner and any(n in have for n in group):
            chain = len(inner) == 1 and catalog.table(group[0]).primary_key
            (_double if chain else _iterate)(tables, catalog, have, inner, down)
        for name in group:
            ways = [k for k, a, b in ends if a == name and b not in group]
            if name in have and ways:
                needed = sorted({c for k in ways for c in (k.parent_columns if down else k.columns)})
                keys = have[name].select(*needed)
                # Downwards keys lead to larger tables, which stay in place where Spark knows that the keys are few.
                leave[name] = staged(keys.distinct(), "keys") if down or len(ways) > 1 else keys
    return have


def identity(catalog: Catalog, name: str, rows: DataFrame) -> tuple[tuple[str, ...], DataFrame]:
    """Seed rows as a key set; a table without a primary key is matched on all its columns."""
    key = catalog.table(name).primary_key or catalog.table(name).stored_columns()
    return tuple(key), rows.select(*key)


#: A table with more references to itself than this first gets every fourth row spliced out, again and again but so often at most.
SPLICED_ROWS, SPLICES = 1_000_000, 16


def _double(tables: Tables, catalog: Catalog, have: dict[str, DataFrame], inner: list, down: bool) -> None:
    """Extends a table along its one reference to itself, in as many rounds as the longest chain has binary digits.

    Every row has one parent, so there is one pointer a row; each round follows
    pointers twice as long as the last one's, from all that is reached or, down,
    to it. A round that reaches nothing new is the last: what twice its reach
    would bring lies one such pointer from something that it would have brought.

    Each round passes all pointers, so many pointers are made fewer first, by
    rounds of `_spliced` that take geometrically less, and what these took out
    is put back afterwards, last round first.
    """
    (k, name, _), = inner
    table, n = tables[name], range(len(k.columns))
    node, up = [f"node{i}" for i in n], [f"up{i}" for i in n]
    start, goal = (up, node) if down else (node, up)
    # A reference that its parent's key can't hold leads nowhere.
    typed = [F.col(c).try_cast(table.schema[p].dataType).alias(u) for c, p, u in zip(k.columns, k.parent_columns, up, strict=True)]
    hop = staged(table.select(*[F.col(c).alias(m) for c, m in zip(k.parent_columns, node, strict=True)], *typed).dropna(), "hops")
    reached = staged(_keyed(have[name], k.parent_columns, node).dropna().distinct(), "reached")
    put_back = []
    # Equal keys have equal hashes for sure where they have one form only.
    if all(isinstance(f.dataType, (T.IntegralType, T.DateType)) for f in hop.schema):
        while len(put_back) < SPLICES and hop.count() > SPLICED_ROWS:
            hop, marks, ways = _spliced(hop, reached, len(put_back), down)
            reached = reached.unionByName(marks)
            put_back.append(ways)
    while True:
        come = _keyed(hop.join(_keyed(reached, node, start), start, "left_semi"), goal, node).distinct()
        new = staged(come.join(reached, node, "left_anti"), "reached")
        if new.isEmpty():
            break
        reached = reached.unionByName(new)
        further = _keyed(hop, (*node, *up), (*[f"mid{i}" for i in n], *[f"far{i}" for i in n]))
        hop = staged(hop.join(further, [F.col(f"up{i}") == F.col(f"mid{i}") for i in n]).select(*node, *[F.col(f"far{i}").alias(f"up{i}") for i in n]), "hops")
    for ways in reversed(put_back):
        back = ways.join(_keyed(reached, node, [f"from{i}" for i in n]), [f"from{i}" for i in n], "left_semi").select(*node).distinct()
        reached = reached.unionByName(staged(back, "back"))
    conditions = [identity(catalog, name, have[name]), (k.parent_columns, _keyed(reached, node, k.parent_columns))]
    if down:
        conditions.append((k.columns, _keyed(reached, node, k.columns)))
    have[name] = _any(table, conditions)


def _spliced(hop: DataFrame, reached: DataFrame, turn: int, down: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pointers without about a fourth of the nodes, what is reached from such as are taken out, and the ways (from, node) by which these are reached from others.

    A node is taken out if a coin says so and another one keeps its parent, so
    no two in a row are; who pointed to it now points to its parent.
    """
    node, up = ([c for c in hop.columns if c.startswith(p)] for p in ("node", "up"))
    n = range(len(node))
    mid, far, origin = ([f"{p}{i}" for i in n] for p in ("mid", "far", "from"))
    coin = lambda columns: F.xxhash64(F.lit(turn), *columns) % 2 == 0
    taken = hop.filter(coin(node) & ~coin(up))
    asking = hop.filter(coin(up)).join(_keyed(taken, (*node, *up), (*mid, *far)), [F.col(u) == F.col(m) for u, m in zip(up, mid, strict=True)], "left")
    hit = F.col(mid[0]).isNotNull()
    jumped = asking.select(*node, *mid, *[F.when(hit, F.col(f)).otherwise(F.col(u)).alias(u) for f, u in zip(far, up, strict=True)])
    others = hop.filter(~coin(node) & ~coin(up)).select(*node, *[F.lit(None).cast(hop.schema[c].dataType).alias(m) for c, m in zip(node, mid, strict=True)], *up)
    spliced = staged(jumped.unionByName(others), "spliced")
    pairs = spliced.filter(hit).select(*node, *mid)
    # Up, whoever points to a node reaches it, and a reached node its parent; down, the other way round.
    ways = _keyed(taken, (*up, *node), (*origin, *node)) if down else _keyed(pairs, (*node, *mid), (*origin, *node))
    led = _keyed(pairs, (*mid, *node), (*origin, *node)) if down else _keyed(taken, (*node, *up), (*origin, *node))
    marks = staged(led.join(_keyed(reached, node, origin), origin, "left_semi").select(*node).distinct(), "marks")
    away = reduce(Column.__or__, [F.col(a) != F.col(b) for a, b in zip(node, up, strict=True)])
    return spliced.filter(away).select(*node, *up), marks, ways


def _iterate(tables: Tables, catalog: Catalog, have: dict[str, DataFrame], inner: list, down: bool) -> None:
    """Extends the tables of a cycle until none grows. Only identities of rows, and what the references need, are staged."""
    names = sorted({b for _, _, b in inner} | {a for _, a, _ in inner})
    told = {n: tuple(catalog.table(n).primary_key or catalog.table(n).stored_columns()) for n in names}
    columns = {n: sorted({*told[n], *(c for k, a, b in inner for t, cs in ((k.parent, k.parent_columns), (k.child, k.columns)) if t == n for c in cs)}) for n in names}
    slim = {n: tables[n].select(*columns[n]) for n in names}
    known = {n: staged(have[n].select(*columns[n]), "subset") for n in names if n in have}
    new = dict(known)
    while new:
        came = {}
        for n in names:
            sets = [_hits(k, new[a], down) for k, a, b in inner if b == n and a in new]
            if not sets:
                continue
            met = _any(slim[n], sets)
            if n in known:
                # A row without a key of its own may have nulls, which equal each other here.
                old = _keyed(known[n], told[n], [f"_old_{c}" for c in told[n]])
                met = met.join(old, [F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in told[n]], "left_anti")
            came[n] = staged(met, "subset")
        for n, rows in came.items():
            known[n] = known[n].unionByName(rows) if n in known else rows
        new = {n: rows for n, rows in came.items() if not rows.isEmpty()}
    for n in names:
        if n in known:
            key = _keyed(known[n], told[n], [f"_key_{c}" for c in told[n]])
            have[n] = tables[n].join(key, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in told[n]], "left_semi").select(tables[n].columns)


def subset(tables: Tables, catalog: Catalog, seeds: Mapping[str, DataFrame | list[DataFrame]], extended: bool = False, paths: bool = False) -> dict[str, DataFrame]:
    """The included rows of every table that is reached, by table name.

    seeds: rows of a table, or several sets of them, which are united. Seeds of
    no rows reach nothing but empty tables. Rows with a null in a foreign key
    reach nothing by it. Tables without a primary key are followed like others.
    """
    start = {}
    for name, rows in seeds.items():
        catalog.table(name)
        several = rows if isinstance(rows, list) else [rows]
        start[name] = several[0]
        for more in several[1:]:
            start[name] = start[name].unionByName(more)
    if paths:
        return _by_paths(tables, catalog, start, extended)
    if extended:
        start = closure(tables, catalog, start, down=True)
    return closure(tables, catalog, start, down=False, own=extended)


def _by_paths(tables: Tables, catalog: Catalog, start: dict[str, DataFrame], extended: bool) -> dict[str, DataFrame]:
    """Path-limited closure: a table's rows are the union over the join paths known when its foreign key was visited."""
    fks = catalog.foreign_keys()
    found: dict[str, list[tuple[tuple[str, ...], DataFrame]]] = {n: [((n,), tables[n].join(identity(catalog, n, r)[1], list(identity(catalog, n, r)[0]), "left_semi"))] for n, r in start.items()}

    def walk(down: bool) -> None:
        visited, todo = set(), list(found)
        while todo:
            at = todo.pop()
            for k in fks:
                a, b = (k.parent, k.child) if down else (k.child, k.parent)
                if a != at or k in visited or not (catalog.table(b).primary_key):
                    continue
                visited.add(k)
                new = [((*path, b), _any(tables[b], [_hits(k, rows, down)])) for path, rows in found[a] if b not in path]
                if new:
                    found.setdefault(b, []).extend(new)
                    todo.append(b)

    if extended:
        walk(True)
    walk(False)
    out = {}
    for name, reached in found.items():
        key = catalog.table(name).primary_key or catalog.table(name).stored_columns()
        out[name] = _any(tables[name], [(tuple(key), rows.select(*key)) for _, rows in reached])
    return out


_HOLE = re.compile(r"\{\{|\}\}|\{([^{}]*)\}|[{}]")


def seed(spark: SparkSession, template: str, tables: Tables, catalog: Catalog) -> tuple[str, DataFrame]:
    """Table name and seed rows of a query template: {*} stands for the table's key, {table} for the table; {{ and }} for braces."""
    holes = [m[1] for m in _HOLE.finditer(template) if m[0] not in ("{{", "}}")]
    named = [h for h in holes if h not in (None, "*")]
    if None in holes or holes.count("*") != 1 or len(named) != 1:
        raise ValueError(f"a seed query has one {{*}} and one {{table}}: {template!r}")
    (name,) = named
    key = catalog.table(name).primary_key
    if not key:
        raise ValueError(f"table {name!r} has no primary key to seed by")
    # A data frame is passed by name, so that no view of the caller's is replaced.
    text = _HOLE.sub(lambda m: {"{{": "{{", "}}": "}}"}.get(m[0]) or (", ".join(f"`{name}`.`{k}`" for k in key) if m[1] == "*" else f"{{seed_rows}} AS `{name}`"), template)
    return name, spark.sql(text, seed_rows=tables[name])
