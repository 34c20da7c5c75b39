"""Collations of a catalog's columns as Spark's: how strings compare in keys."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.catalog import Table

# Names of collations that say nothing about case and accents by their parts.
_NAMED = {"nocase": "UTF8_LCASE", "rtrim": "UTF8_BINARY_RTRIM", "binary": "UTF8_BINARY", "c": "UTF8_BINARY", "posix": "UTF8_BINARY", "ucs_basic": "UTF8_BINARY", "default": "UTF8_BINARY"}


def spark_collation(name: str) -> str:
    """Spark's collation for one of a database, by which values are equal.

    Names of MySQL and SQL Server say by their parts whether case (ci, cs) and
    accents (ai, as) count or all bytes do (bin); MySQL's case-blind ones are
    blind to accents too, unless they say otherwise. Any other name is of a
    collation that orders by a language but tells all strings apart, as those
    of Postgres do. A name that Spark itself has is taken as it is.
    """
    if re.match(r"(UTF8_BINARY|UTF8_LCASE|UNICODE)(_|$)", name):
        return name
    if name.lower() in _NAMED:
        return _NAMED[name.lower()]
    parts = re.split(r"[_\-.]", name.lower())
    if "bin" in parts or "bin2" in parts:
        return "UTF8_BINARY"
    if "ci" in parts:
        mysql = parts[0].startswith(("utf8", "latin1", "ascii", "ucs2", "utf16", "utf32")) and parts[-1] == "ci"
        return "UNICODE_CI_AI" if "ai" in parts or (mysql and "as" not in parts) else "UNICODE_CI"
    if "cs" in parts:
        return "UNICODE_AI" if "ai" in parts else "UNICODE"
    return "UTF8_BINARY"


def collated(df: DataFrame, table: Table) -> DataFrame:
    """df with its string columns under the collations that the table declares, so that grouping and joining follow them."""
    told = {c.name: spark_collation(c.collation) for c in table.columns if c.collation and not c.ignore}
    return df.select(*[F.collate(F.col(f"`{f.name}`"), told[f.name]).alias(f.name) if f.name in told and isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])


def plain(df: DataFrame) -> DataFrame:
    """df with all strings compared by their bytes again."""
    return df.select(*[F.collate(F.col(f"`{f.name}`"), "UTF8_BINARY").alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])


def blind(kind: T.DataType) -> bool:
    """Whether values of a type can be equal and yet differ."""
    return isinstance(kind, T.StringType) and kind.collation != "UTF8_BINARY"
