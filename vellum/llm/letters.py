"""Words of letters in any script, lower-cased one code point for one."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .vectext import SEP, Chunk, runs


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it is a letter, and its lower case."""
    letter = np.zeros(SEP + 1, bool)
    lower = np.arange(SEP + 1, dtype=np.uint32)
    for c in range(SEP):
        x = chr(c)
        if x.isalpha():
            letter[c] = True
            y = x.lower()
            if len(y) == 1:
                lower[c] = ord(y)
    return letter, lower


def letter_words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points, starts and ends of the runs of letters, and where each text's begin."""
    letter, lower = tables()
    starts, ends = runs(letter[chunk.codes])
    return lower[chunk.codes], starts, ends, chunk.per_text(starts)
