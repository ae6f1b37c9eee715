"""Splitting texts into the pieces that byte-level BPE encodes one by one."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import regex

#: Characters beyond which a text is split step by step, and pieces of a step.
PART = 1 << 20


def latin_pattern(pattern: str) -> str | None:
    """The pattern for texts of code points below 256, with \\s, \\S, \\p{L} and \\p{N} spelled out as classes; None if it has other escapes."""
    points = [chr(i) for i in range(256)]
    classes = {r"\p{L}": [c for c in points if unicodedata.category(c)[0] == "L"], r"\p{N}": [c for c in points if unicodedata.category(c)[0] == "N"], r"\s": regex.findall(r"\s", "".join(points))}
    spelled = {k: "".join(f"\\x{ord(c):02x}" for c in v) for k, v in classes.items()}
    out, inside, i = [], False, 0
    while i < len(pattern):
        if pattern[i] == "\\":
            name = next((k for k in (*spelled, r"\S") if pattern.startswith(k, i)), None)
            if name is None or name == r"\S" and inside:
                return None
            out.append(f"[^{spelled[r'\s']}]" if name == r"\S" else spelled[name] if inside else f"[{spelled[name]}]")
            i += len(name)
        else:
            inside = pattern[i] == "[" or inside and pattern[i] != "]"
            out.append(pattern[i])
            i += 1
    return "".join(out)


class Splitter:
    """All matches of a pattern; re is quicker than regex where its results are the same."""

    def __init__(self, pattern: str):
        latin = latin_pattern(pattern)
        self.any, self.latin = regex.compile(pattern), re.compile(latin) if latin else None

    def _pattern(self, text: str) -> re.Pattern | regex.Pattern:
        if self.latin:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.any
            return self.latin
        return self.any

    def split(self, text: str) -> list[str]:
        return self._pattern(text).findall(text)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The same, of long texts PART pieces at a time."""
        pattern = self._pattern(text)
        if len(text) <= PART:
            yield pattern.findall(text)
            return
        found = (m.group() for m in pattern.finditer(text))
        while some := list(islice(found, PART)):
            yield some
