"""Words and word shingles of many texts at once, as 64-bit hashes in flat arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence
from gc import collect

import numpy as np
import pyarrow as pa

ODD = 0x9E3779B97F4A7C15
BASE = 0x2545F4914F6CDD1D
SLICE_BYTES = 1 << 19  # texts worked on together, at some hundred times the memory; a longer text is one slice
SLICE_ROWS = 2000  # and at most so many of them
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


POWERS: list[np.ndarray] = []  # the longest made since the worker last gave its memory back


def powers(length: int) -> list[np.ndarray]:
    """At least so many powers of BASE and of its inverse, modulo 2**64."""
    if not POWERS or len(POWERS[0]) < length:
        made = [np.full(length, base, np.uint64) for base in (BASE, pow(BASE, -1, 1 << 64))]
        for row in made:
            row[0] = 1
            np.multiply.accumulate(row, out=row)
        POWERS[:] = made
    return POWERS


def give_back() -> None:
    """Return what a worker no longer uses to the system: it waits for tasks of other stages beside the next ones."""
    POWERS.clear()
    collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library that does so by itself or not at all
        pass


def slices(texts: Sequence[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in order as UTF-8, in runs of about SLICE_BYTES, with the index of the first."""
    run, size, first = [], 0, 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if run and size + len(raw) > SLICE_BYTES:
            yield first, run
            run, size, first = [], 0, i
        run.append(raw)
        size += len(raw)
    if run:
        yield first, run


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, text index)`` of every word, in order; A-Z count as a-z."""
    data = np.frombuffer((b"\n".join(raws) + b"\n").translate(LOWER), np.uint8)
    space = SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))
    starts, ends = edge[0::2], edge[1::2]
    length = 1 << max(16, int(len(data)).bit_length())
    up, down = powers(length)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)])])
        words = mix((total[ends] - total[starts]) * down[starts])
    begins = np.cumsum([0, *[len(r) + 1 for r in raws[:-1]]])
    return words, np.searchsorted(begins, starts, "right") - 1


def shingle_sets(raws: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, text index)`` of the distinct shingles of each text, sorted by text, then hash.

    A text of fewer words than ``width`` has its whole sequence of words as the only one; a
    text without words has none.
    """
    words, owner = word_hashes(raws)
    count = len(words)
    with np.errstate(over="ignore"):
        full = np.zeros(0, np.uint64)
        whose = np.zeros(0, owner.dtype)
        if count >= width:
            inside = owner[:count - width + 1] == owner[width - 1:]
            full = np.zeros(count - width + 1, np.uint64)
            for i in range(width):
                full = mix(full * np.uint64(ODD) + words[i:count - width + 1 + i])
            full, whose = full[inside], owner[:count - width + 1][inside]
        per_text = np.bincount(owner, minlength=len(raws))
        short, short_owner = [], []
        firsts = np.concatenate([[0], np.cumsum(per_text)])
        for t in np.flatnonzero((per_text > 0) & (per_text < width)):
            h = np.full(1, per_text[t], np.uint64)
            for w in words[firsts[t]:firsts[t + 1]]:
                h = mix(h * np.uint64(ODD) + w)
            short.append(h[0])
            short_owner.append(t)
    hashes = np.concatenate([full, np.array(short, np.uint64)])
    owners = np.concatenate([whose, np.array(short_owner, whose.dtype)])
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return hashes[fresh], owners[fresh]


def text_slices(source, column: int = 1) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Arrow batches cut to slices, with the texts of ``column`` as UTF-8; the memory goes back after the last."""
    batch = part = raws = None
    for batch in source:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            for first, raws in slices(part.column(column).to_pylist()):
                yield part.slice(first, len(raws)), raws
    del batch, part, raws
    give_back()
