"""Fill-in-middle transformation.

The tokenizers library's Split pre-tokenizer, which needs no training, cuts a
text into isolated matches of a pattern and says where each stands in code
points. The number of matches is n; two draws between 0 and n, put in order,
rank two of the matches' ends, and these ends cut the text into prefix, middle
and suffix, which are written down in another order behind marks of their own.
Draws are digests of the document's id, so a rerun makes the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.llm.common import col, kept, pieces

#: Code points that the library gets at once, where the pattern allows a cut.
WINDOW = 1 << 16
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Settings:
    """pattern: the units. cut: a string behind which a unit always ends, so that long texts can be cut there; empty if there is none.

    salt goes before the id in the digest that draws come from. Of a hundred
    documents `rate` are transformed on average, `spm` of them with the suffix first.
    """

    pattern: str = r"[^\n]*\n|[^\n]+"
    cut: str = "\n"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    salt: str = "7:"
    rate: int = 100
    spm: int = 50

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        # An end of one mark that begins another, or a mark inside another, could make a mark where none was written.
        meets = any(a[i:] == b[: len(a) - i] for a in marks for b in marks for i in range(1, len(a)))
        if not all(marks) or meets or any(marks[i] in marks[j] for i in range(3) for j in range(3) if i != j):
            raise ValueError(f"marks overlap: {marks}")

    def draws(self, key: str) -> list[int]:
        digest = hashlib.sha256((self.salt + key).encode()).digest()
        return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


class Splitter:
    def __init__(self, settings: Settings):
        from tokenizers import Regex, pre_tokenizers

        self.split, self.cut = pre_tokenizers.Split(Regex(settings.pattern), behavior="isolated"), settings.cut

    def ends(self, text: str) -> list[int]:
        """Code-point offsets at which the units of a text end."""
        found: list[int] = []
        start = 0
        while start < len(text):
            at = text.find(self.cut, start + WINDOW) if self.cut else -1
            stop = at + len(self.cut) if at >= 0 else len(text)
            found += [start + end for _, (_, end) in self.split.pre_tokenize_str(text[start:stop])]
            start = stop
        return found


def rearranged(text: str, key: str, settings: Settings, splitter: Splitter) -> tuple[int, str, int | None, int | None, str]:
    """n, form, length of prefix and of middle, and the output of one text."""
    ends = splitter.ends(text)
    n = len(ends)
    a, b, whether, which = settings.draws(key)
    if not text or whether % 100 >= settings.rate or any(m in text for m in (settings.prefix, settings.suffix, settings.middle)):
        return n, PLAIN, None, None, text
    low, high = sorted((a % (n + 1), b % (n + 1)))
    first, second = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if which % 100 < settings.spm:
        form, parts = SPM, (settings.suffix, suffix, settings.prefix, prefix, settings.middle, middle)
    else:
        form, parts = PSM, (settings.prefix, prefix, settings.suffix, suffix, settings.middle, middle)
    return n, form, len(prefix), len(middle), "".join(parts)


MADE = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])


def transform(docs: DataFrame, settings: Settings = Settings(), text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without the text, with n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output.

    One row per input row and no shuffle; repeated rows and ids give the same
    row each time, an empty table an empty one. A null text counts as an empty
    one, which stays plain; so does a text that holds a mark. A null id draws
    like an empty one. Columns that have one of the new names are replaced.
    """
    keep = [f for f in docs.schema.fields if f.name != text and f.name.lower() not in MADE.names]
    source = docs.select(*kept(keep), F.coalesce(col(id_col).cast("string"), F.lit("")).alias("draw"), F.coalesce(col(text), F.lit("")).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(settings)
        for part in pieces(batches, "body"):
            rows = [rearranged(t.decode("utf-8", "replace"), k, settings, splitter) for t, k in zip(part.column("body").to_pylist(), part.column("draw").to_pylist(), strict=True)]
            made = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], [*(f.name for f in keep), *MADE.names])

    return source.mapInArrow(run, T.StructType([*keep, *MADE.fields]))


def restored(output: Column, form: Column, settings: Settings = Settings()) -> Column:
    """The text that an output was made of, by its form and marks alone."""

    def between(start: Column, stop: Column) -> Column:
        return F.substring(output, start, stop - start)

    p, s, m = (F.lit(x) for x in (settings.prefix, settings.suffix, settings.middle))
    # The text holds no mark, so each stands once, where it was written.
    at_p, at_s, at_m, end = F.locate(settings.prefix, output), F.locate(settings.suffix, output), F.locate(settings.middle, output), F.length(output) + 1
    after_p, after_s, after_m = at_p + F.length(p), at_s + F.length(s), at_m + F.length(m)
    psm = F.concat(between(after_p, at_s), between(after_m, end), between(after_s, at_m))
    spm = F.concat(between(after_p, at_m), between(after_m, end), between(after_s, at_p))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
