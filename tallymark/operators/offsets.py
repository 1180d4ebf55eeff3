"""Other readings of a text with maps back to it: sorted pieces in place of a place for each character.

A reading that leaves characters out is a list of kept pieces, each with where it begins in the reading and in the text before;
a place is found by binary search. Readings of readings are looked up one map after the other. A decoded run stands for the whole of it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field


@dataclass
class Reading:
    """A reading's name and text, and the way back: maps from the last step to the first, or one span for all of it."""

    name: str
    text: str
    maps: list[tuple[list[int], list[int]]] = field(default_factory=list)
    whole: tuple[int, int] | None = None

    def place(self, k: int) -> int:
        """Where character k of the reading stands in the text."""
        for starts, places in self.maps:
            at = bisect_right(starts, k) - 1
            k = places[at] + k - starts[at]
        return k

    def span(self, start: int, end: int) -> tuple[int, int]:
        """What characters start to end of the reading, which is not empty, cover in the text."""
        return self.whole or (self.place(start), self.place(end - 1) + 1)

    def without(self, pattern: re.Pattern) -> Reading:
        """The reading less all matches of a pattern; itself where there is none."""
        pieces, starts, places, at, size = [], [], [], 0, 0
        for m in pattern.finditer(self.text):
            if m.start() > at:
                pieces.append(self.text[at : m.start()])
                starts.append(size)
                places.append(at)
                size += m.start() - at
            at = m.end()
        if not at:
            return self
        if at < len(self.text):
            pieces.append(self.text[at:])
            starts.append(size)
            places.append(at)
        return Reading(self.name, "".join(pieces), [(starts, places), *self.maps])


def merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover together, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def touches(cover: tuple[list[int], list[int]], start: int, end: int) -> bool:
    """Whether a span shares a character with what is covered."""
    starts, ends = cover
    k = bisect_right(starts, end - 1) - 1
    return k >= 0 and ends[k] > start


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, in order and apart, replaced: one pass, one copy."""
    out, at = [], 0
    for start, end, new in spans:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])
