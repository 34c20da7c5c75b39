"""Rule bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements
and one long whose bit i says that rule i failed. Policies are versioned bit
masks over the ledger: applying another policy, or asking what a policy would
keep without one of its rules, reads only those longs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.llm.common import SPACE_RE, bind, fresh

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_caps_words")


@dataclass(frozen=True)
class Rule:
    """`fails` is a condition over MEASURES. A rule's place in RULES is its bit: append, never reorder."""

    name: str
    fails: Callable[[], Column]


c = F.col
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda: c("n_words") < 20),
    Rule("repeated_windows", lambda: 100 * c("n_repeat_words") > 30 * c("n_words")),
    Rule("symbol_heavy", lambda: 100 * c("n_symbols") > 50 * c("n_words")),
    Rule("repeated_lines", lambda: (c("n_lines") >= 4) & (100 * c("n_dup_lines") > 50 * c("n_lines"))),
    Rule("odd_word_length", lambda: (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words"))),
    Rule("shouting", lambda: 100 * c("n_caps_words") > 50 * c("n_words")),
)
BASE = ("few_words", "repeated_windows")

#: Policies by version: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": BASE,
    "web-1": (*BASE, "symbol_heavy", "repeated_lines", "odd_word_length", "shouting"),
}


def mask(names) -> int:
    at = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << at[n] for n in names)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_RE), lambda w: w != "")


def _covered(hashes: Column) -> Column:
    """Words inside windows that occur twice or more, from the hashes of all windows in order."""
    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def positions(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"]))

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return bind(ranked, lambda s: bind(positions(s), total))


def _repeat_words(words: Column) -> Column:
    """Windows are compared by a 64-bit hash of their word hashes; within one text a chance collision is out of reach."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_covered(hashes))

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(bind(F.transform(words, lambda w: F.xxhash64(w)), lambda h: bind(windows(h), counted)))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds MEASURES (long) to docs; columns of these names are replaced. A null text measures as an empty one."""
    body = F.coalesce(F.col(text), F.lit(""))
    symbols = sum((F.octet_length(body) - F.octet_length(F.replace(body, F.lit(s))) for s in SYMBOLS), F.lit(0))
    # A line with a word, as it is; white-space lines don't count.
    lines = F.filter(F.split(body, "\n"), lambda x: F.ltrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    words = _words(body)
    measured = F.struct(
        bind(
            words,
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.size(F.filter(w, lambda x: (x == F.upper(x)) & (x != F.lower(x)))).cast("long").alias("n_caps_words"),
                _repeat_words(w).cast("long").alias("n_repeat_words"),
            ),
        ).alias("w"),
        bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        symbols.cast("long").alias("n_symbols"),
    )
    name = fresh(docs, "measured")
    at = {"n_lines": "l.n_lines", "n_dup_lines": "l.n_dup_lines", "n_symbols": "n_symbols"}
    out = docs.drop(*MEASURES).withColumn(name, measured)
    return out.withColumns({m: F.col(f"`{name}`.{at.get(m, f'w.{m}')}") for m in MEASURES}).drop(name)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with MEASURES and fail_bits (long). One row per input row, whatever its values; no shuffle."""
    bits = sum((F.when(r.fails(), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)), F.lit(0))
    return measure(docs, text).withColumn("fail_bits", bits.cast("long"))


def passes(policy: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: policy, rule, n_failed, n_only (rejected by this rule alone), kept_without.

    Grouped by the distinct bit patterns first (at most 2 to the number of
    rules), so what is shuffled doesn't grow with the corpus. An empty ledger
    gives the rules with zeros.
    """
    spark, m = book.sparkSession, mask(POLICIES[policy])
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("bits")).count()
    rules = spark.createDataFrame([(r, mask([r])) for r in POLICIES[policy]], "rule string, bit long")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("count"))), F.lit(0))
    return (
        rules.join(patterns, F.col("bits").isNotNull() & (F.col("bit") > 0), "left")
        .groupBy("rule")
        .agg(count(hit).alias("n_failed"), count(F.col("bits") == F.col("bit")).alias("n_only"), count((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("kept_without"))
        .select(F.lit(policy).alias("policy"), "rule", "n_failed", "n_only", "kept_without")
    )
