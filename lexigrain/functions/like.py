"""LIKE patterns taken apart at planning time."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Run:
    """A stretch of literal text; open sides touch a wildcard."""

    text: str
    open_left: bool
    open_right: bool

    def tokens(self) -> list[tuple[str, str]]:
        """(token, how) with how one of exact, prefix, suffix, contains: what terms of a matching text must look like."""
        words = [w for w in re.split(r"[\W_]+", self.text.lower()) if w]
        if not words:
            return []
        word = lambda c: bool(re.fullmatch(r"[^\W_]", c))
        cut_left = self.open_left and word(self.text[0])
        cut_right = self.open_right and word(self.text[-1])
        out = []
        for i, w in enumerate(words):
            left, right = cut_left and i == 0, cut_right and i == len(words) - 1
            out.append((w, "contains" if left and right else "suffix" if left else "prefix" if right else "exact"))
        return out


@dataclass(frozen=True)
class LikePattern:
    runs: tuple[Run, ...]

    @classmethod
    def parse(cls, pattern: str, escape: str = "\\") -> LikePattern:
        """Full LIKE grammar: % and _ are wildcards, the escape character makes them and itself literal."""
        runs, text, open_left, i = [], "", False, 0
        while i < len(pattern):
            c = pattern[i]
            if c == escape:
                if i + 1 == len(pattern) or pattern[i + 1] not in ("%", "_", escape):
                    raise ValueError(f"the escape character must be followed by a wildcard or itself: {pattern!r}")
                text, i = text + pattern[i + 1], i + 1
            elif c in "%_":
                if text:
                    runs.append(Run(text, open_left, True))
                text, open_left = "", True
            else:
                text += c
            i += 1
        if text:
            runs.append(Run(text, open_left, False))
        return cls(tuple(runs))

    def contained(self) -> str | None:
        """The text of a plain %text% pattern."""
        one = self.runs[0] if len(self.runs) == 1 else None
        return one.text if one and one.open_left and one.open_right else None

    def indexable(self) -> bool:
        """Whether term lookups find a superset: some token, and only ASCII, whose lower case depends on no context."""
        return all(r.text.isascii() for r in self.runs) and any(r.tokens() for r in self.runs)
