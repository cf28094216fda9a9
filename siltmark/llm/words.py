"""Words of a text without regard to case, accents, punctuation, spacing and markup."""

from __future__ import annotations

import html
import re
import unicodedata

_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_WORD = re.compile(r"[^\W_]+")


class _Folded(dict):
    """Code point -> its letters in lower case without accents; marks and invisible characters vanish."""

    def __missing__(self, code: int) -> str:
        kept = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if unicodedata.category(c) not in ("Mn", "Cf"))
        self[code] = unicodedata.normalize("NFKD", kept.casefold())
        return self[code]


_FOLDED = _Folded()


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, lower case, without accents; tags and invisible characters are none.

    Null and blank texts have no words.
    """
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(text.lower() if text.isascii() else text.translate(_FOLDED))
