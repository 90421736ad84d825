"""Texts cut where a byte-level tokenizer always cuts, so that each distinct piece needs its work once in a task."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

# The characters with the Unicode property White_Space.
WHITE = "\t-\r \x85\xa0  -     　"
_DOUBLE = re.compile(f"[{WHITE}][{WHITE}]")
_SEGMENT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Byte-level pre-tokenization (contractions, letters, numbers, other marks, white space).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Generations:
    """A dictionary of computed values that keeps the lately used: two generations of at most `most` keys each."""

    def __init__(self, values: Callable[[list[str]], list], most: int = 500_000) -> None:
        self.values, self.most = values, most
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def learn(self, wanted: set[str]) -> dict[str, object]:
        """A dictionary that holds all of `wanted`."""
        new = wanted - self.young.keys()
        if len(self.young) + len(new) > self.most:
            self.old, self.young, new = self.young, {}, wanted
        again = new & self.old.keys()
        self.young.update((k, self.old[k]) for k in again)
        missing = list(new - again)
        for a in range(0, len(missing), 4096):
            part = missing[a : a + 4096]
            self.young.update(zip(part, self.values(part), strict=True))
        return self.young


class SegmentCache:
    """Values of text segments by a batch function, kept for the segments lately met.

    A byte-level pre-token never holds white space after something else, so a text may be cut before any white space that
    follows something else: the pieces' tokens are those of the text.
    """

    def __init__(self, values: Callable[[list[str]], list]) -> None:
        self.spaced = Generations(lambda part: values([" " + x for x in part]))  # by what follows a single space
        self.other = Generations(values)

    def of(self, texts: list[str]) -> list[list]:
        """For each text the values of its segments, in order."""
        plain = [None if _DOUBLE.search(t) else t.split(" ") for t in texts]
        rest = [_SEGMENT.findall(t) if p is None else (p[:1] if p[0] else []) for t, p in zip(texts, plain, strict=True)]
        spaced = self.spaced.learn(set(chain.from_iterable(p[1:] for p in plain if p)))
        other = self.other.learn(set(chain.from_iterable(rest)))
        return [[other[x] for x in r] + ([spaced[x] for x in p[1:]] if p else []) for r, p in zip(rest, plain, strict=True)]
