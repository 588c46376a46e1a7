"""Memories for tokenizers that meet the same runs of a text again and again."""

from __future__ import annotations

import ctypes
import re
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Runs between spaces and pieces of them that a Python worker remembers (about 200 bytes each). A
#: full memory is emptied and refilled.
CHUNKS, PIECES = 1_000_000, 200_000

# Letters and digits of Latin script; with the signs below, the only ones in usual texts.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ʯⱥⱦ"
#: Any sign for which Python's tables and the tokenizers library's might differ.
UNUSUAL = re.compile("[^\t-\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧‰-›]")


_remembered: list[dict] = []


def remembered() -> dict:
    """A dictionary for what an operator remembers in a Python worker until another one calls `release`."""
    _remembered.append({})
    return _remembered[-1]


def release() -> None:
    """Let go of what other operators remember: workers are used again by the next stage.

    Freed memory is given back to the system, as an allocator may keep it for a worker that waits.
    """
    for held in _remembered:
        held.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim:
        trim(0)


class Memory(dict):
    """A dictionary that computes what it lacks and never holds more than `most` entries."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) < 64:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


_TABLE = dict(enumerate(byte_letters()))


def in_letters(text: str) -> str:
    """The bytes of a text, each as its stand-in."""
    if text.isascii() and text.isprintable():
        return text.replace(" ", _TABLE[32])
    return text.encode().decode("latin-1").translate(_TABLE)


_LAYOUTS = {(w, n): struct.Struct(f"<{n}{c}") for w, c in ((2, "H"), (4, "I")) for n in range(64)}


def packed(ids: list[int], width: int) -> bytes:
    """Ids as little-endian unsigned integers of 2 or 4 bytes."""
    return _LAYOUTS[width, len(ids)].pack(*ids) if len(ids) < 64 else np.array(ids, f"<u{width}").tobytes()
