"""Terms: lower-cased maximal runs of [0-9a-z] and non-ASCII characters, i.e. `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z."""

from __future__ import annotations

_KEPT = {*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)}
_TABLE = bytes(b if b in _KEPT else b + 32 if ord("A") <= b <= ord("Z") else ord(" ") for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8, in order; none for a null text."""
    return (text or b"").translate(_TABLE).split()
