"""Counts of one text, for quality rules and classifiers. Words are runs of anything but ASCII white space."""

from __future__ import annotations

from collections import Counter

import numpy as np

SYMBOLS = b"#*$%&|<>"

# First code points of blocks and the script that each belongs to.
_BLOCKS = [(0x0, "other"), (0x41, "latin"), (0x5B, "other"), (0x61, "latin"), (0x7B, "other"), (0xC0, "latin"), (0x250, "other"),
           (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"),
           (0x900, "devanagari"), (0x980, "other"), (0xE00, "thai"), (0xE80, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
           (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
           (0xD7B0, "other")]
_STARTS = np.array([start for start, _ in _BLOCKS])
SCRIPTS = sorted({name for _, name in _BLOCKS})
_SCRIPT = np.array([SCRIPTS.index(name) for _, name in _BLOCKS])


def script(text: str) -> str:
    """Script of most letters ("other" without any)."""
    if text.isascii():
        return "latin" if any(c.isalpha() for c in text[:256]) or any(c.isalpha() for c in text) else "other"
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    count = np.bincount(_SCRIPT[np.searchsorted(_STARTS, codes, side="right") - 1], minlength=len(SCRIPTS))
    count[SCRIPTS.index("other")] = 0
    return SCRIPTS[int(count.argmax())] if count.any() else "other"


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found more than once."""
    windows = list(zip(*(words[k:] for k in range(width)), strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.array([k for k, w in enumerate(windows) if seen[w] > 1])
    np.add.at(covered, at, 1)
    np.add.at(covered, at + width, -1)
    return int((np.cumsum(covered) > 0).sum())


def base_counts(text: str, raw: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated windows."""
    space = len(raw) - len(raw.translate(None, b" \t\n\v\f\r"))
    lines = [line for line in raw.split(b"\n") if line.strip(b" \t\v\f\r")]
    return (len(words), len(text) - space, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words))
