"""Text as a reader sees it."""

from __future__ import annotations

import re
import unicodedata

_ASCII_UNSEEN = re.compile(r"[\x00-\x08\x0e-\x1b\x7f]")
# Signs without a picture that Unicode does not class as formatting.
_UNSEEN = "".join(map(chr, [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)]))
_UNSEEN_TABLE = dict.fromkeys(map(ord, _UNSEEN))


def visible(text: str | None) -> str:
    """NFKC, case folded, without invisible characters; null is empty."""
    if not text:
        return ""
    if text.isascii():
        return _ASCII_UNSEEN.sub("", text).lower()
    text = unicodedata.normalize("NFKC", text.translate(_UNSEEN_TABLE))
    text = "".join(
        c for c in text if (k := unicodedata.category(c)) != "Cf" and (k != "Cc" or c.isspace())
    )
    return unicodedata.normalize("NFKC", text.casefold())
