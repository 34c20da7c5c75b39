"""Column types, defaults and names of several SQL dialects, as Column expressions over declared text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.catalog import NAME_BYTES, SUFFIXES

# Spellings that name the same type, blanks left out, by dialect.
ALIASES = {
    "postgres": {
        "INTEGER": "INT", "SERIAL": "INT", "SERIAL4": "INT", "INT4": "INT", "BIGSERIAL": "BIGINT", "SERIAL8": "BIGINT", "INT8": "BIGINT",
        "SMALLSERIAL": "SMALLINT", "SERIAL2": "SMALLINT", "INT2": "SMALLINT", "DECIMAL": "NUMERIC", "FLOAT4": "REAL", "FLOAT8": "DOUBLE PRECISION",
        "CHARACTERVARYING": "VARCHAR", "CHARACTER": "CHAR", "TIMESTAMPWITHOUTTIMEZONE": "TIMESTAMP", "TIMESTAMPWITHTIMEZONE": "TIMESTAMPTZ",
        "TIMEWITHOUTTIMEZONE": "TIME", "TIMEWITHTIMEZONE": "TIMETZ", "BITVARYING": "VARBIT", "BOOL": "BOOLEAN",
    },
    "mysql": {"INTEGER": "INT", "DEC": "NUMERIC", "DECIMAL": "NUMERIC", "BOOL": "TINYINT", "BOOLEAN": "TINYINT"},
    "sqlserver": {
        "BINARYVARYING": "VARBINARY", "INTEGER": "INT", "NATIONALCHARACTERVARYING": "NVARCHAR", "CHARACTERVARYING": "VARCHAR", "CHARACTER": "CHAR",
        "DEC": "NUMERIC", "DECIMAL": "NUMERIC",
    },
    "sqlite": {},
}

# Ways to say now, by dialect.
NOW = {"sqlite": ["DATETIME()", "DATETIME('NOW')"], "postgres": ["NOW()"], "mysql": ["NOW()"], "sqlserver": ["GETDATE()"]}
KEYWORD_DEFAULTS = ["CURRENT_DATE", "CURRENT_TIME", "CURRENT_TIMESTAMP", "NULL"]


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key) if table else F.lit(None).cast("string")


def normalize_type(declared: Column, dialect: str) -> Column:
    """struct(type, arg1, arg2) such that two spellings of one type are equal; empty strings for absent arguments."""
    text = F.upper(F.trim(declared))
    shape = r"(?s)^([^(]*)\((.*)\)([^)]*)$"
    has_args = text.rlike(shape)
    part = lambda i: F.when(has_args, F.trim(F.regexp_extract(text, shape, i))).otherwise(F.lit(""))
    base = F.when(has_args, part(1)).otherwise(text)
    args, tail = part(2), F.regexp_replace(part(3), " ", "")
    first = F.trim(F.substring_index(args, ",", 1))
    second = F.when(args.contains(","), F.trim(F.regexp_extract(args, r"(?s)^[^,]*,(.*)$", 1))).otherwise(F.lit(""))
    array = F.lit(False)
    if dialect == "postgres":
        array = base.endswith("[]")
        base = F.when(array, F.regexp_replace(base, r"\[\]$", "")).otherwise(base)
    unsigned = F.lit(False)
    if dialect == "mysql":
        unsigned = base.endswith(" UNSIGNED")
        base = F.regexp_replace(base, " (UN)?SIGNED$", "")
    tight = F.regexp_replace(base, " ", "")
    name = F.coalesce(_lookup(ALIASES[dialect], tight), base)
    if dialect == "postgres":
        name = F.when(tight.isin("TIME", "TIMESTAMP") & (tail == "WITHTIMEZONE"), F.concat(tight, F.lit("TZ"))).otherwise(name)
        name = F.concat(name, F.when(array, F.lit("[]")).otherwise(F.lit("")))
    if dialect == "mysql":
        whole = tight.isin("SMALLINT", "MEDIUMINT", "INT", "INTEGER", "BIGINT")
        first = F.when(tight.isin("BOOL", "BOOLEAN"), "1").when(whole | ((tight == "TINYINT") & (first != "1")), "").otherwise(first)
        second = F.when(whole | tight.isin("TINYINT", "BOOL", "BOOLEAN"), "").otherwise(second)
        name = F.concat(name, F.when(unsigned, F.lit(" UNSIGNED")).otherwise(F.lit("")))
    return F.struct(name.alias("type"), first.alias("arg1"), second.alias("arg2"))


def normalize_default(declared: Column, dialect: str) -> Column:
    """A default's text such that two spellings of one value are equal; empty for none."""
    text = F.trim(declared)
    upper = F.upper(text)
    out = F.when(text == "", "").when(upper.isin("1", "TRUE"), "'1'").when(upper.isin("0", "FALSE"), "'0'").when(upper.isin(KEYWORD_DEFAULTS), upper)
    out = out.when(upper.isin(NOW[dialect]), "CURRENT_TIMESTAMP")
    if dialect == "postgres":
        out = out.when(text.contains("::"), F.substring_index(text, "::", 1))
    return out.otherwise(text)


def generated_name(table: Column, columns: Column, kind: str) -> Column:
    """catalog.generate_name over a table name and an array of columns, for ASCII names."""
    suffix = SUFFIXES[kind]
    stem = F.replace(F.concat_ws("_", table, F.concat_ws("_", columns)), F.lit(" "), F.lit("_"))
    return F.concat(F.substring(stem, 1, NAME_BYTES - len(suffix)), F.lit(suffix))


def is_literal(text: Column) -> Column:
    """Whether a default is a quoted string, a number, a truth value, NULL or one of the current-time keywords."""
    return F.coalesce(text.rlike(r"(?s)^'.*'$") & (F.length(text) >= 2), F.lit(False)) | F.upper(text).isin("TRUE", "FALSE", *KEYWORD_DEFAULTS) | text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")


def identifier(name: Column, keywords=()) -> Column:
    """A name as Spark SQL takes it: bare if it is plain lower case and no keyword, else between backticks."""
    plain = name.rlike("^[_a-z][_a-z0-9]*$") & ~name.isin(list(keywords)) if keywords else name.rlike("^[_a-z][_a-z0-9]*$")
    return F.when(plain, name).otherwise(F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`")))


# Spark types of normalised type names.
SPARK_TYPES: dict[str, T.DataType] = {
    "BOOLEAN": T.BooleanType(), "BIT": T.BooleanType(), "TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "MEDIUMINT": T.IntegerType(), "INT": T.IntegerType(),
    "INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "TINYINT UNSIGNED": T.ShortType(), "SMALLINT UNSIGNED": T.IntegerType(), "MEDIUMINT UNSIGNED": T.IntegerType(),
    "INT UNSIGNED": T.LongType(), "BIGINT UNSIGNED": T.DecimalType(20, 0), "FLOAT": T.FloatType(), "REAL": T.FloatType(), "DOUBLE": T.DoubleType(),
    "DOUBLE PRECISION": T.DoubleType(), "DATE": T.DateType(), "DATETIME": T.TimestampNTZType(), "DATETIME2": T.TimestampNTZType(), "SMALLDATETIME": T.TimestampNTZType(),
    "TIMESTAMP": T.TimestampNTZType(), "TIMESTAMPTZ": T.TimestampType(), "DATETIMEOFFSET": T.TimestampType(), "BYTEA": T.BinaryType(), "BINARY": T.BinaryType(),
    "VARBINARY": T.BinaryType(), "TINYBLOB": T.BinaryType(), "BLOB": T.BinaryType(), "MEDIUMBLOB": T.BinaryType(), "LONGBLOB": T.BinaryType(), "VARBIT": T.BinaryType(),
}


def spark_type(name: str, arg1: str = "", arg2: str = "") -> T.DataType:
    """Type of a column of a normalised type; text for what has no closer one."""
    if name.endswith("[]"):
        return T.ArrayType(spark_type(name[:-2], arg1, arg2))
    if name == "NUMERIC":
        return T.DecimalType(min(38, int(arg1)), int(arg2 or 0)) if arg1 else T.DecimalType(38, 18)
    return SPARK_TYPES.get(name, T.StringType())


def typmod_size(modifier: Column, bits: bool = False) -> Column:
    """Length of a character type (or of a bit type, whose number has no header) by its type modifier; null for none (-1)."""
    return F.when(modifier >= 0, modifier if bits else modifier - 4)


def typmod_numeric(modifier: Column) -> Column:
    """struct(precision, scale) of a numeric type by its type modifier: two 16-bit numbers behind a header of 4; nulls for none (-1)."""
    body = F.when(modifier >= 4, modifier - 4)
    return F.struct(F.shiftright(body, 16).bitwiseAND(F.lit(65535)).alias("precision"), body.bitwiseAND(F.lit(65535)).alias("scale"))
