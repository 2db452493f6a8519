"""Encode whole texts through pieces that can be encoded on their own.

The split pattern of byte-level tokenisers never lets a token reach over a space that follows a non-space and precedes
one: such a space always opens a token. So a text may be cut before every space, unless a run of white space holds a
space that is followed by more white space (or ends the text); such a text stays one piece. Equal pieces are encoded
once per worker: most words of a corpus are repeated.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_UNSAFE = rf"{_SPACE} ({_SPACE}|\z)"

#: Takes texts, returns their ids in one array and the number of ids of each.
Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def joined(texts: list[str], encode: Callable[[list[str]], list], byte_lengths: np.ndarray,
           size: int = 16_384) -> tuple[np.ndarray, np.ndarray]:
    """Encode pieces that each start with a space and a non-space as a few long texts, which costs fewer calls.

    The pieces' ids are told apart by the number of bytes that each id stands for."""
    longs, held, total = [], [], 0
    for text in texts:
        held.append(text)
        total += len(text)
        if total >= size:
            longs.append("".join(held))
            held, total = [], 0
    if held:
        longs.append("".join(held))
    ids = np.concatenate([np.asarray(x, np.int32) for x in encode(longs)])
    ends = np.cumsum(byte_lengths[ids])
    cuts = np.searchsorted(ends, np.cumsum([len(t.encode()) for t in texts]))
    return ids, np.diff(np.concatenate([[-1], cuts]))


class Pieces:
    """Cache of encoded pieces over an :data:`Encode`.

    ``limit`` (pieces) and ``characters`` (of them) bound the memory of the cache, not the work: beyond either, the pieces
    that were met most often stay, up to half of both, and the rest is encoded anew when it is met again. Texts that
    hold one of the ``literals`` stay one piece."""

    def __init__(self, encode: Encode, limit: int = 600_000, characters: int = 16_000_000, literals: Sequence[str] = ()):
        self.encode, self.limit, self.characters = encode, limit, characters
        self.unsafe = "|".join([_UNSAFE, *map(re.escape, literals)])
        self.known: dict[str, int] = {"": 0}
        self.new: list[str] = []
        self.held, self.hits = 0, np.zeros(1, np.int64)
        self.ids, self.lengths, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _shrink(self) -> None:
        often = np.argsort(-self.hits, kind="stable")
        often = often[(self.hits[often] > 1) & (often > 0)][:self.limit // 2]
        names = list(self.known)
        sizes = np.array([len(names[k]) for k in often.tolist()], np.int64)
        kept = np.concatenate([[0], np.sort(often[np.cumsum(sizes) <= self.characters // 2])])
        self.known = {names[k]: number for number, k in enumerate(kept.tolist())}
        self.held, self.hits = sum(map(len, self.known)), self.hits[kept] // 2
        starts, self.lengths = self.starts[kept], self.lengths[kept]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.ids = self.ids[np.arange(self.lengths.sum()) + np.repeat(starts - self.starts, self.lengths)]
        self._keep(kept)

    def _keep(self, kept: np.ndarray) -> None:
        """What else is held per piece is cut down to ``kept``."""

    def _number(self, texts: list[str]) -> np.ndarray:
        known = self.known
        out = list(map(known.get, texts))
        if None in out:
            for k, number in enumerate(out):
                if number is None:
                    out[k] = known.setdefault(texts[k], len(known))
            first = len(known) - len(self.lengths) - len(self.new)
            new = list(islice(reversed(known), first))[::-1]
            self.new += new
            self.held += sum(map(len, new))
        return np.array(out, np.int64)

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all texts in one array, and the number of pieces of each text (at least one)."""
        if len(self.known) > self.limit or self.held > self.characters:
            self._shrink()
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        texts = texts.cast(pa.large_string())
        whole = pc.match_substring_regex(texts, self.unsafe)
        parts = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        heads = np.cumsum(sizes) - sizes
        flat = parts.flatten()
        coded = flat.dictionary_encode()
        inner = self._number([" " + x for x in coded.dictionary.to_numpy(zero_copy_only=False).tolist()])
        pieces = inner[coded.indices.to_numpy(zero_copy_only=False)]
        pieces[heads] = self._number(pc.if_else(whole, texts, flat.take(pa.array(heads))).to_numpy(zero_copy_only=False).tolist())
        if self.new:
            ids, lengths = self.encode(self.new)
            self.new = []
            pa.default_memory_pool().release_unused()
            self.ids = np.concatenate([self.ids, ids.astype(np.int32, copy=False)])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.starts = np.cumsum(self.lengths) - self.lengths
        seen = np.bincount(pieces, minlength=len(self.lengths))
        seen[:len(self.hits)] += self.hits
        self.hits = seen
        return pieces, sizes

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each text."""
        pieces, sizes = self.numbers(texts)
        lengths = self.lengths[pieces]
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        where = np.arange(bounds[-1]) + np.repeat(self.starts[pieces] - bounds[:-1], lengths)
        return self.ids[where], np.diff(bounds[np.concatenate([[0], np.cumsum(sizes)])])
