"""Terms of texts in Arrow batches: maximal runs of allowed bytes, exact, as codes into a dictionary of the batch.

All bytes that separate terms are ASCII, so a scan of UTF-8 bytes finds the same terms as a scan of code points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import text_bytes, word_spans

BLANK = 0x20


def byte_map(*allowed: tuple[int, int]) -> np.ndarray:
    """What each byte reads as: allowed bytes as they are, A-Z lower-cased, and all others blank."""
    seen = np.full(256, BLANK, np.uint8)
    for low, high in allowed:
        seen[low : high + 1] = np.arange(low, high + 1)
    upper = np.arange(0x41, 0x5B)
    seen[upper] = np.where(seen[upper] == BLANK, BLANK, upper + 0x20)
    return seen


#: Letters of ASCII and all beyond ASCII; with digits too.
LETTERS = byte_map((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
ALNUM = byte_map((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def coded(col: pa.Array, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code of every term of every text on end, n + 1 offsets of the texts, the distinct terms); null counts as empty."""
    data, offsets = text_bytes(col)
    data = seen[data]
    starts, ends, at = word_spans(data, offsets)
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[data != BLANK])))
    held = terms.dictionary_encode()
    return held.indices.to_numpy(zero_copy_only=False).astype(np.int64), at, held.dictionary
