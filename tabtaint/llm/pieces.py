"""Cutting texts into pieces that byte-level tokenizers encode independently of each other."""

from __future__ import annotations

import re

_TWO_BLANKS = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S)(?= \S)")


def pieces(text: str) -> list[str]:
    """``text`` cut before each single space between two characters that are not white space.

    The splitting pattern of byte-level tokenizers attaches such a space to what follows it and
    no match crosses it, so the pieces' tokens in a row are the text's tokens."""
    if not text:
        return []
    if text[0] != " " and text[-1] != " " and "\x00" not in text and not _TWO_BLANKS.search(text):
        return text.replace(" ", "\x00 ").split("\x00")
    return _CUT.split(text)
