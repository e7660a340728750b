"""Context-tree weighting over binary-decomposed bytes: contexts of texts and a table of their bytes' probabilities (numpy)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Byte that ends every text and stands before it (it never occurs in UTF-8).
END = 0xFF
#: Bytes of the longest context, and the most that a key of 64 bits has room for.
DEPTH, MOST_DEPTH = 5, 6
#: Bytes that are worked on together in a task (arrays of 8 bytes for each), and keys that are counted together.
PIECE, COUNTED = 1 << 18, 1 << 22


def text_bytes(text: str | None) -> bytes:
    """The text's UTF-8 with A-Z lower-cased, and its end."""
    return (text or "").encode("utf-8", "replace").lower() + bytes([END])


def pieces(texts: Iterable[bytes], depth: int, size: int = PIECE) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """Lists of (text's number, the `depth` bytes before, bytes) of about `size` bytes; a longer text comes in several."""
    out: list[tuple[int, bytes, bytes]] = []
    held = 0
    for number, text in enumerate(texts):
        for at in range(0, len(text), size):
            before = text[max(0, at - depth) : at]
            body = text[at : at + size]
            out.append((number, bytes([END]) * (depth - len(before)) + before, body))
            held += len(body)
            if held >= size:
                yield out
                out, held = [], 0
    if out:
        yield out


def contexts(batch: list[tuple[int, bytes, bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, key) of every byte: a key is the context (the byte just before lowest) and the byte in its low bits."""
    data = np.frombuffer(b"".join(before + body for _, before, body in batch), np.uint8)
    sizes = np.array([len(body) for _, _, body in batch], np.int64)
    begins = np.cumsum(sizes + depth) - sizes
    kept = np.ones(len(data), bool)
    keys = data.astype(np.int64)
    for k in range(1, depth + 1):
        kept[begins - k] = False
        keys[k:] |= np.left_shift(data[:-k], 8 * k, dtype=np.int64)
    return np.repeat([n for n, _, _ in batch], sizes), keys[kept]


def counted(texts: Iterable[bytes], depth: int, size: int = COUNTED) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct keys, times) of the texts' bytes, of at most `size` bytes (or a piece) at a time; holds one array of so many keys."""
    held, filled = np.empty(max(size, 2 * PIECE), np.int64), 0
    for batch in pieces(texts, depth):
        keys = contexts(batch, depth)[1]
        if filled + len(keys) > len(held):
            yield _runs(held[:filled])
            filled = 0
        held[filled : filled + len(keys)] = keys
        filled += len(keys)
    if filled:
        yield _runs(held[:filled])


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, times); sorts the array in place."""
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(first, append=len(keys))


class KeyTable:
    """A hash table of keys (not negative) and numbers, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(1, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.float32)
        open_, step = np.arange(len(keys)), 0
        while len(open_):
            place = self._place(keys[open_], step)
            free = self.keys[place] < 0
            taken, first = np.unique(place[free], return_index=True)
            chosen = open_[free][first]
            self.keys[taken], self.values[taken] = keys[chosen], values[chosen]
            open_, step = np.setdiff1d(open_, chosen, assume_unique=True), step + 1

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> KeyTable:
        """The table whose arrays these are (`keys` and `values` of another one); nothing is copied."""
        table = cls.__new__(cls)
        table.bits, table.keys, table.values = len(keys).bit_length() - 1, keys, values
        return table

    def _place(self, keys: np.ndarray, step: int) -> np.ndarray:
        mixed = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (mixed.astype(np.int64) + step) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each key is held, its number or 0)."""
        out, found = np.zeros(len(keys)), np.zeros(len(keys), bool)
        open_, step = np.arange(len(keys)), 0
        while len(open_):
            ask = keys[open_]
            place = self._place(ask, step)
            there = self.keys[place]
            hit = there == ask
            out[open_[hit]] = self.values[place[hit]]
            found[open_[hit]] = True
            open_, step = open_[~hit & (there >= 0)], step + 1
        return found, out
