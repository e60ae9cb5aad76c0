"""Folding of a text to words whose case, punctuation, spacing, markup and look don't count."""

from __future__ import annotations

import html
import re
import unicodedata

# Letters of other scripts that look like Latin ones, and the letters they stand for.
LOOKALIKES = str.maketrans({
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "г": "r", "ո": "n", "һ": "h",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "σ": "o", "ς": "s",
    "ı": "i", "ɩ": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ø": "o", "đ": "d", "ħ": "h", "ł": "l", "ŧ": "t",
})
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿\U000e0000-\U000e0fff]")
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_LINE_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑]\s*\n\s*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_MARK = re.compile("[̀-ͯ]")


def fold(text: str) -> str:
    """The text in lower case and compatibility form, without tags, entities, invisible characters and accents."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        text = unicodedata.normalize("NFKD", text)
        text = _MARK.sub("", text).casefold().translate(LOOKALIKES)
    else:
        text = text.lower()
    if "\n" in text:
        text = _LINE_HYPHEN.sub("", text)
    return text


def words(text: str) -> list[str]:
    """Folded words of ``text``; an apostrophe within a word is left out."""
    found = _WORD.findall(fold(text))
    return [w.replace("'", "").replace("’", "") for w in found]
