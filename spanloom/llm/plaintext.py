"""Texts reduced to comparable words: case, character forms, markup, invisible marks and layout removed."""

from __future__ import annotations

import re
import unicodedata

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ɡ": "g", "ı": "i", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
_LOOKALIKES = str.maketrans(LOOKALIKES)
_INLINE = re.compile(r"</?(?:b|i|u|s|em|strong|span|a|code|font|mark|sup|sub|small)(?:\s[^<>]{0,200})?/?>", re.I)
_TAG = re.compile(r"</?[a-z][^<>]{0,200}>|<!--.{0,200}?-->|&(?:nbsp|amp|lt|gt|quot|#\d+);", re.I)
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑]\s*\n\s*(?=[^\W\d_])")
_HIDDEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")
_MARKS = re.compile("[̀-ͯ]")
WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case without accents, look-alike letters and invisible marks; layout and markup stay."""
    if text.isascii():
        return text.lower()
    text = _HIDDEN.sub("", unicodedata.normalize("NFKD", text))
    return _MARKS.sub("", text).casefold().translate(_LOOKALIKES)


def unmarked(text: str) -> str:
    """Without markup and words broken at a line's end."""
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "\n" in text:
        text = _BROKEN.sub("", text)
    return text


def words(text: str | None) -> list[str]:
    """Comparable words of a text; none of a null text."""
    return WORD.findall(fold(unmarked(_HIDDEN.sub("", text)))) if text else []
