"""Forced-boundary BPE encoding and decoding.

A byte pair that stands side by side in no token of the vocabulary can never be
merged across, so the place between its bytes is a certain cut: the fragments
on either side encode independently and their ids are concatenated. White space
stands inside no token, which cuts a text into words; inside a word the pairs
that the vocabulary lacks cut further. Only the fragment that ends a word
carries the end-of-word mark, so inner fragments go through a model without it.
Words and fragments recur, so both levels keep bounded caches.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from relweave.llm.common import col, kept

#: Entries of each of a worker's caches, which are emptied when full.
CACHE = 100_000
#: Documents of one returned Arrow batch.
BATCH = 256

#: The settings of a tokenizers file that this codec follows; any other file is refused.
KNOWN = {
    "model": {"type": "BPE"},
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "decoder": None,
}

#: Packed ids and decoded text.
Coded = tuple[bytes, bytes]


def byte_alphabet() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    kept = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(moved)) for b in range(256)]


class ForcedBoundaryBpe:
    """Encodes with the vocabulary of a tokenizers file whose model is a byte-level BPE with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix")
        told = {"model": {k: v for k, v in model.items() if v and k not in ("vocab", "merges", "end_of_word_suffix")}, **{k: spec.get(k) for k in ("normalizer", "pre_tokenizer", "decoder")}}
        if not self.suffix or told != KNOWN or any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: this codec encodes as {KNOWN} say, with word ends; the file says {told}")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.ending = self.whole.model
        self.inner = models.BPE(vocab=model["vocab"], merges=merges)
        self.special = re.compile(b"|".join(re.escape(t["content"].encode()) for t in spec["added_tokens"]))
        self.tokens = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        plain = [t.removesuffix(self.suffix) for t in model["vocab"]]
        #: Pairs that occur inside a token; any other pair is a forced boundary.
        self.pairs = {t[i : i + 2] for t in plain for i in range(len(t) - 1)}
        alphabet = byte_alphabet()
        blanks = [alphabet[b] for b in b"\t\n\x0b\x0c\r "]
        if any(c in p for p in self.pairs for c in blanks):
            raise ValueError("white space stands inside a token of this vocabulary")
        self.visible = {b: c for b, c in enumerate(alphabet)}
        # This vocabulary's splitting pattern, as it acts on words of ASCII and Latin-1 letters, which are
        # their own normal form and fall to lower case one by one; the library splits any other word.
        self.plain = re.compile("[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
        self.split = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
        self.packed = {i: struct.pack("<I", i) for i in self.tokens}
        self.blank_token = {i: f" {t}".encode() for i, t in self.tokens.items()}
        self.words: dict[bytes, Coded] = {}
        self.pieces: dict[str, Coded] = {}
        self.fragments: dict[str, list[int]] = {}

    def cuts(self, piece: str) -> list[str]:
        at = [i for i in range(1, len(piece)) if piece[i - 1 : i + 1] not in self.pairs]
        return [piece[a:b] for a, b in zip([0, *at], [*at, len(piece)], strict=True)] if at else [piece]

    def fragment(self, text: str) -> list[int]:
        """Ids of a fragment that doesn't end its word."""
        ids = self.fragments.get(text)
        if ids is None:
            ids = [t.id for t in self.inner.tokenize(text)]
            if len(self.fragments) >= CACHE:
                self.fragments.clear()
            self.fragments[text] = ids
        return ids

    def piece(self, text: str) -> Coded:
        """A piece of the splitting pattern, at its end the end-of-word mark."""
        known = self.pieces.get(text)
        if known is None:
            *inner, last = self.cuts(text)
            ids = [i for part in inner for i in self.fragment(part)]
            ids += [t.id for t in self.ending.tokenize(last)]
            if len(self.pieces) >= CACHE:
                self.pieces.clear()
            known = self.pieces[text] = self.coded(ids)
        return known

    def coded(self, ids: list[int]) -> Coded:
        return b"".join([self.packed[i] for i in ids]), b"".join([self.blank_token[i] for i in ids])

    def word(self, word: bytes) -> Coded:
        """Ids of a word as little-endian unsigned 32-bit integers, and its decoded text with a leading blank."""
        if self.special.search(word):
            return self.coded(self.whole.encode(word.decode("utf-8"), add_special_tokens=False).ids)
        text = word.decode("utf-8")
        if self.plain.fullmatch(text):
            found = self.split.findall(text.lower())
            if not (text.isascii() and text.isprintable()):
                found = [p.encode().decode("latin-1").translate(self.visible) for p in found]
        else:
            found = [p for p, _ in self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(text))]
        if len(found) == 1:
            return self.piece(found[0])
        parts = [self.piece(p) for p in found]
        return b"".join([i for i, _ in parts]), b"".join([d for _, d in parts])

    def encode(self, text: bytes) -> tuple[bytes, bytes]:
        """Ids of a whole text and what they decode to: the tokens, joined by blanks."""
        found, known = [], self.words
        for w in text.split():
            x = known.get(w)
            if x is None:
                if len(known) >= CACHE:
                    known.clear()
                x = known[w] = self.word(w)
            found.append(x)
        return b"".join([x[0] for x in found]), b"".join([x[1] for x in found])[1:]

    def decode(self, ids: bytes) -> str:
        return " ".join(self.tokens[i] for (i,) in struct.iter_unpack("<I", ids))


_loaded: dict[str, ForcedBoundaryBpe] = {}


def load(vocab: str) -> ForcedBoundaryBpe:
    """The codec of a vocabulary file: a path, or the name of one of the installed public vocabularies."""
    if vocab not in _loaded:
        if not os.path.isabs(vocab):
            import public_tokenizers

            _loaded[vocab] = ForcedBoundaryBpe(public_tokenizers.path(vocab))
        else:
            _loaded[vocab] = ForcedBoundaryBpe(vocab)
    return _loaded[vocab]


def encode(docs: DataFrame, vocab: str = "word_bpe_49k.json", text: str = "text") -> DataFrame:
    """docs without the text, with n_tokens (long), ids (binary, little-endian unsigned 32-bit) and decoded (string).

    One row per input row and no shuffle; repeated rows give equal rows, an
    empty table an empty one, and a text of any length is encoded whole. A null
    text encodes as an empty one: no tokens, empty ids, empty decoded text. The strings of special tokens in a
    text become their ids. Columns named n_tokens, ids or decoded are replaced,
    others kept whatever their names.
    """
    made = ("n_tokens", "ids", "decoded")
    fields = [f for f in docs.schema.fields if f.name != text and f.name.lower() not in made]
    source = docs.select(*kept(fields), col(text).cast("binary").alias("body"))
    schema = T.StructType([*fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(vocab)
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                part = whole.slice(start, BATCH)
                coded = [codec.encode(t or b"") for t in part.column("body").to_pylist()]
                columns = part.columns[: len(fields)]
                columns += [pa.array([len(i) // 4 for i, _ in coded], pa.int64()), pa.array([i for i, _ in coded], pa.binary()), pa.array([d for _, d in coded], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in fields), *made])

    return source.mapInArrow(run, schema)
