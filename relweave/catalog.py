"""The catalog model: what a set of relational tables declares about itself.

Spark's own tables keep neither keys nor checks, so they live here, as plain
dataclasses that read and write JSON. `None` in a list field means unknown,
an empty list means known to be empty. `ignore` marks a soft-deleted object.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Iterator
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

PRIMARY_KEY, UNIQUE, FOREIGN_KEY, CHECK, EXCLUDE = "PRIMARY KEY", "UNIQUE", "FOREIGN KEY", "CHECK", "EXCLUDE"
#: What becomes of rows whose parent goes or changes its key; no rule is NO ACTION.
CASCADE, SET_NULL, SET_DEFAULT, RESTRICT, NO_ACTION = "CASCADE", "SET NULL", "SET DEFAULT", "RESTRICT", "NO ACTION"


@dataclass
class Column:
    name: str
    type: str
    not_null: bool = False
    default: str = ""
    generated: str = ""
    identity: str = ""
    collation: str = ""
    is_primary_key: bool = False
    is_unique: bool = False
    references: str = ""
    comment: str = ""
    ignore: bool = False


@dataclass
class Constraint:
    kind: str
    columns: list[str]
    name: str = ""
    references_table: str = ""
    references_columns: list[str] = field(default_factory=list)
    check: str = ""
    operators: list[str] = field(default_factory=list)
    predicate: str = ""
    update_rule: str = ""
    delete_rule: str = ""
    deferrable: bool = False
    ignore: bool = False


@dataclass
class Index:
    columns: list[str]
    name: str = ""
    kind: str = ""
    unique: bool = False
    include: list[str] = field(default_factory=list)
    predicate: str = ""
    ignore: bool = False


@dataclass
class Table:
    name: str
    columns: list[Column] = field(default_factory=list)
    constraints: list[Constraint] = field(default_factory=list)
    indexes: list[Index] = field(default_factory=list)
    comment: str = ""
    ignore: bool = False

    def __post_init__(self):
        """Names what has no name, and marks columns that a single-column constraint is about."""
        at = {c.name: c for c in self.columns}
        for c in self.constraints:
            c.name = c.name or generate_name(c.kind, self.name, c.columns)
            if missing := [n for n in c.columns if n not in at]:
                raise ValueError(f"{self.name}: constraint {c.name} is over unknown columns {missing}")
            for n in c.columns:
                at[n].is_primary_key |= c.kind == PRIMARY_KEY
                at[n].is_unique |= c.kind == UNIQUE and len(c.columns) == 1
                if c.kind == FOREIGN_KEY and len(c.columns) == 1:
                    at[n].references = f"{c.references_table}.{c.references_columns[0]}"
        for x in self.indexes:
            x.name = x.name or generate_name("INDEX", self.name, x.columns)

    def of(self, kind: str) -> list[Constraint]:
        return [c for c in self.constraints if c.kind == kind and not c.ignore]

    @property
    def primary_key(self) -> list[str]:
        found = self.of(PRIMARY_KEY)
        return found[0].columns if found else []

    def stored_columns(self) -> list[str]:
        """What dumps, loads and subsets read and write: generated columns are derived again instead."""
        return [c.name for c in self.columns if not c.generated and not c.ignore]


@dataclass
class View:
    name: str
    sql: str = ""
    materialized: bool = False
    columns: list[str] = field(default_factory=list)
    ignore: bool = False


@dataclass
class Routine:
    name: str
    sql: str = ""
    kind: str = "FUNCTION"
    ignore: bool = False


@dataclass
class Trigger:
    name: str
    table: str
    sql: str = ""
    ignore: bool = False


@dataclass
class Enum:
    name: str
    labels: list[str] = field(default_factory=list)
    ignore: bool = False


@dataclass
class Domain:
    name: str
    type: str
    not_null: bool = False
    default: str = ""
    checks: list[str] = field(default_factory=list)
    ignore: bool = False


@dataclass(frozen=True)
class ForeignKey:
    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    name: str = ""
    delete_rule: str = NO_ACTION
    update_rule: str = NO_ACTION


@dataclass
class Catalog:
    name: str = ""
    tables: list[Table] = field(default_factory=list)
    views: list[View] | None = None
    routines: list[Routine] | None = None
    enums: list[Enum] | None = None
    domains: list[Domain] | None = None
    extensions: list[str] | None = None
    triggers: list[Trigger] | None = None

    def table(self, name: str) -> Table:
        for t in self.tables:
            if t.name == name and not t.ignore:
                return t
        raise KeyError(f"no table {name!r} in the catalog")

    def foreign_keys(self) -> list[ForeignKey]:
        """All foreign keys between tables of the catalog; one that points outside it is an error."""
        known = {t.name for t in self.tables if not t.ignore}
        out = []
        for t in self.tables:
            for c in [] if t.ignore else t.of(FOREIGN_KEY):
                if c.references_table not in known:
                    raise ValueError(f"{t.name}.{c.name} references {c.references_table!r}, which the catalog doesn't have")
                out.append(ForeignKey(t.name, tuple(c.columns), c.references_table, tuple(c.references_columns), c.name, c.delete_rule or NO_ACTION, c.update_rule or NO_ACTION))
        return out

    def merged(self, other: Catalog) -> Catalog:
        """A deep copy, with the other's tables replacing or joining this one's."""
        mine, theirs = copy.deepcopy(self), copy.deepcopy(other)
        names = {t.name for t in theirs.tables}
        mine.tables = [t for t in mine.tables if t.name not in names] + theirs.tables
        return mine

    def to_json(self) -> str:
        return json.dumps(_plain(self), indent=2)

    @staticmethod
    def from_json(text: str) -> Catalog:
        return _catalog(json.loads(text))


def _plain(x: Any) -> Any:
    """Nested dicts without empty fields; an unknown list stays away, a known empty one is kept."""
    if is_dataclass(x):
        out = {}
        for f in fields(x):
            v = getattr(x, f.name)
            keep_empty = isinstance(x, Catalog) and isinstance(v, list)
            if keep_empty or v not in ("", False, None, []):
                out[f.name] = _plain(v)
        return out
    return [_plain(v) for v in x] if isinstance(x, list) else x


def _catalog(d: dict) -> Catalog:
    def table(t: dict) -> Table:
        parts = {"columns": Column, "constraints": Constraint, "indexes": Index}
        return Table(**{k: [parts[k](**v) for v in x] if k in parts else x for k, x in t.items()})

    kinds = {"tables": table, "views": lambda v: View(**v), "routines": lambda v: Routine(**v), "enums": lambda v: Enum(**v), "domains": lambda v: Domain(**v), "triggers": lambda v: Trigger(**v)}
    return Catalog(**{k: [kinds[k](v) for v in x] if k in kinds else x for k, x in d.items()})


SUFFIXES = {PRIMARY_KEY: "_pkey", FOREIGN_KEY: "_fkey", UNIQUE: "_key", "INDEX": "_idx", CHECK: "_check", EXCLUDE: "_excl"}
#: Bytes that the strictest of the usual databases allows a name.
NAME_BYTES = 63


def generate_name(kind: str, table: str, columns: list[str]) -> str:
    """table_column_..._suffix, blanks as underscores, cut before the suffix to NAME_BYTES bytes."""
    suffix = SUFFIXES[kind]
    stem = "_".join([table, *columns]).replace(" ", "_").encode()
    return stem[: NAME_BYTES - len(suffix)].decode("utf-8", "ignore") + suffix


def strongly_connected(nodes: list[str], edges: list[tuple[str, str]]) -> Iterator[list[str]]:
    """Groups of tables that reach each other, a group before those its edges lead to."""
    reach = {n: {n} for n in nodes}
    grown = True
    while grown:
        grown = False
        for a, b in edges:
            if not reach[b] <= reach[a]:
                reach[a] |= reach[b]
                grown = True
    groups = {frozenset(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    # A group that reaches another reaches strictly more tables.
    yield from sorted((sorted(g) for g in groups), key=lambda g: (-len(reach[g[0]]), g))


def _t(name: str, columns: str, pk: str = "", fks: dict[str, str] | None = None) -> Table:
    cons = [Constraint(PRIMARY_KEY, pk.split())] if pk else []
    for local, target in (fks or {}).items():
        table, column = target.split(".")
        cons.append(Constraint(FOREIGN_KEY, [local], references_table=table, references_columns=[column]))
    keyed = set(pk.split())
    return Table(name, [Column(n, t, not_null=n in keyed) for n, t in (c.split(":") for c in columns.split())], cons)


def sample_catalog() -> Catalog:
    """Keys and foreign keys of the sample tables (a star of orders, with an event log and document labels)."""
    return Catalog(
        "sample",
        [
            _t("region", "r_regionkey:INT r_name:TEXT", "r_regionkey"),
            _t("nation", "n_nationkey:INT n_name:TEXT n_regionkey:INT", "n_nationkey", {"n_regionkey": "region.r_regionkey"}),
            _t("customer", "c_custkey:BIGINT c_name:TEXT c_nationkey:INT c_acctbal:DOUBLE c_mktsegment:TEXT", "c_custkey", {"c_nationkey": "nation.n_nationkey"}),
            _t("supplier", "s_suppkey:BIGINT s_name:TEXT s_nationkey:INT s_acctbal:DOUBLE", "s_suppkey", {"s_nationkey": "nation.n_nationkey"}),
            _t("part", "p_partkey:BIGINT p_name:TEXT p_brand:TEXT p_type:TEXT p_size:INT p_retailprice:DOUBLE", "p_partkey"),
            _t("orders", "o_orderkey:BIGINT o_custkey:BIGINT o_orderstatus:TEXT o_totalprice:DOUBLE o_orderdate:TIMESTAMP o_orderpriority:TEXT", "o_orderkey", {"o_custkey": "customer.c_custkey"}),
            _t(
                "lineitem",
                "l_orderkey:BIGINT l_partkey:BIGINT l_suppkey:BIGINT l_linenumber:INT l_quantity:DOUBLE l_extendedprice:DOUBLE l_discount:DOUBLE l_tax:DOUBLE l_returnflag:TEXT l_linestatus:TEXT l_shipdate:TIMESTAMP",
                "",
                {"l_orderkey": "orders.o_orderkey", "l_partkey": "part.p_partkey", "l_suppkey": "supplier.s_suppkey"},
            ),
            _t("events", "event_id:BIGINT ts:TIMESTAMP user_id:BIGINT event_type:TEXT value:DOUBLE props:TEXT", "event_id", {"user_id": "customer.c_custkey"}),
        ],
        views=[],
        routines=[],
    )
