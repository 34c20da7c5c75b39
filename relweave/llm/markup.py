"""Tags of HTML as they stand in a page, in time linear in its length."""

from __future__ import annotations

import re

#: A comment or declaration (no groups), or a tag: slash of an end tag, name, attributes. Quotes count after an equals sign only.
#: A tag ends at its bracket, before the next one that opens, or with the page, so no search for its end is made twice.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^<>])*+)(?:>|(?=<)|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)

# Elements of HTML without content, those whose content isn't markup, and those that begin a block of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_ENDS = {t: re.compile(rf"</{t}(?![^\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}


def raw_end(source: str, tag: str, at: int) -> tuple[int, int]:
    """Where the content of a raw element that begins at `at` ends, and where its end tag does."""
    end = _ENDS[tag].search(source, at)
    return (end.start(), end.end()) if end else (len(source), len(source))
