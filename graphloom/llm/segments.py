"""Cutting texts where byte-level tokenizers always cut: before a lone space.

With the usual pre-tokenizer pattern a single space between two visible
characters always begins a new piece, and nothing before it changes how what
follows is split. Texts are therefore encoded segment by segment, and a worker
remembers the segments it has seen: a bounded cache that changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np

CUT = re.compile(r"(?<=\S) (?=\S)")
#: Segments, and characters of segments, a worker remembers before it starts anew.
CACHE_SEGMENTS, CACHE_CHARS = 400_000, 12_000_000


class SegmentCoder:
    """texts -> token ids, with ``encode`` for what is new.

    It gets segments that begin with their only white space, and others, and gives
    the 32-bit ids of each in order, as bytes.
    """

    def __init__(self, encode: Callable[[list[str], list[str]], Iterable[bytes]]):
        self.encode = encode
        self.after_space: dict[str, bytes | None] = {}
        self.whole: dict[str, bytes] = {}
        self.chars = 0

    def _learn(self, space: set[str], whole: set[str]) -> None:
        plain = []
        for s in space:
            # '' or outer white space: the space before it isn't alone, so no cut is allowed there
            if not s or s[0].isspace() or s[-1].isspace():
                self.after_space[s] = None
            else:
                plain.append(s)
        rest = list(whole)
        self.chars += sum(map(len, space)) + sum(map(len, whole))
        ids = iter(self.encode([" " + s for s in plain], rest))
        for s in plain:
            self.after_space[s] = next(ids)
        for s in rest:
            self.whole[s] = next(ids)

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, end to end, and how many each text has."""
        if len(self.after_space) + len(self.whole) > CACHE_SEGMENTS or self.chars > CACHE_CHARS:
            self.after_space.clear()
            self.whole.clear()
            self.chars = 0
        parts = [t.split(" ") for t in texts]
        new: set[str] = set()
        heads: set[str] = set()
        for p in parts:
            new.update(p[1:])
            heads.add(p[0])
        new -= self.after_space.keys()
        heads = {h for h in heads if h and not h[-1].isspace()} - self.whole.keys()
        self._learn(new, heads)
        out: list[bytes | None] = []
        slow: dict[int, list[str]] = {}
        for k, p in enumerate(parts):
            head = p[0]
            if len(p) == 1 and not head:
                out.append(b"")
                continue
            got = [self.whole.get(head), *map(self.after_space.__getitem__, p[1:])] if head else [None]
            if None in got:
                cut = CUT.split(texts[k])
                slow[k] = [cut[0], *(" " + s for s in cut[1:])]
                out.append(None)
            else:
                out.append(b"".join(got))
        if slow:
            self._learn(set(), {s for cut in slow.values() for s in cut} - self.whole.keys())
            for k, cut in slow.items():
                out[k] = b"".join(map(self.whole.__getitem__, cut))
        counts = np.array([len(b) // 4 for b in out], np.int64)
        return np.frombuffer(b"".join(out), np.int32), counts
