"""Cosine of many texts with a bounded list of canonical ones, inside Arrow batches.

The index holds the canonical texts' unit vectors by gram. A task counts the grams of its texts in
flat arrays, so neither the grams of a text nor its pairs become rows; only matches do.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

SPACES = [9, 10, 11, 12, 13, 32]  # what a word ends at
SLICE_CHARS = 1 << 18  # counted together; a longer text is counted in such steps
CELLS = 1 << 21  # of a table of texts by grams, or of products made at once


class GramIndex:
    """Unit vectors ``(text number, gram, weight)`` by gram, with the idf of every gram."""

    def __init__(self, grams: Sequence[str], idf: np.ndarray, gram_of: np.ndarray, text_of: np.ndarray,
                 weight: np.ndarray, texts: int):
        letters = sorted({c for g in grams for c in g} - {" "})
        if len(letters) > 0xFFFD:
            raise ValueError("too many different characters for an index of grams")
        code = {" ": 1, **{c: i for i, c in enumerate(letters, 2)}}  # 0 is any other character
        self.letters = np.array([ord(c) for c in letters], np.int64)
        keys = [self.key([code[c] for c in g]) for g in grams]
        order = sorted(range(len(grams)), key=lambda i: (len(grams[i]), keys[i]))
        sizes = np.array([len(grams[i]) for i in order], np.int64)
        keys = np.array([keys[i] for i in order], np.uint64)
        self.first = {int(n): int(np.searchsorted(sizes, n)) for n in np.unique(sizes)}
        self.keys = {n: keys[sizes == n] for n in self.first}
        self.idf = np.asarray(idf, float)[order]
        place = np.empty(len(grams), np.int64)
        place[order] = np.arange(len(grams))
        by_gram = np.argsort(place[gram_of], kind="stable")
        self.lists = np.bincount(place[gram_of], minlength=len(grams))
        self.begins = np.cumsum(self.lists) - self.lists
        self.text_of, self.weight = np.asarray(text_of, np.int32)[by_gram], np.asarray(weight, float)[by_gram]
        self.texts = texts

    @staticmethod
    def key(codes):
        """Up to four characters of 16 bits as one number."""
        out = codes[0]
        for c in codes[1:]:
            out = (out << 16) | c
        return out

    def codes(self) -> np.ndarray:
        """Code of every code point."""
        table = np.zeros(0x110000, np.uint16)
        table[self.letters] = np.arange(2, 2 + len(self.letters))
        table[SPACES] = 1
        return table

    def counts(self, texts: Sequence[str], codes: np.ndarray) -> np.ndarray:
        """How often each text holds each gram; texts are in lower case."""
        points = codes[np.frombuffer(f" {'\n'.join(texts)} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])
        owner = np.concatenate([owner[:1], owner])
        space = points == 1
        once = np.ones(len(points), bool)
        once[1:] = ~(space[1:] & space[:-1])
        points, owner, width = points[once], owner[once], len(self.idf)
        out = np.zeros(len(texts) * width)
        for at in range(0, len(points), SLICE_CHARS):
            c, o = points[at:at + SLICE_CHARS + 3].astype(np.uint64), owner[at:at + SLICE_CHARS + 3]
            cells = []
            for n, keys in self.keys.items():
                starts = min(SLICE_CHARS, len(c) - n + 1)
                if starts <= 0:
                    continue
                found = self.key([c[i:i + starts] for i in range(n)])
                place = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                hit = np.flatnonzero(keys[place] == found)  # no known gram has a space inside
                # blanks around a word may lie beside two texts, its characters belong to one
                whose = o[hit + 1] if n > 2 else np.where(c[hit] == 1, o[hit + 1], o[hit])
                cells.append(whose * width + (place[hit] + self.first[n]))
            out += np.bincount(np.concatenate(cells), minlength=len(out)) if cells else 0
        return out.reshape(len(texts), width)

    def matches(self, texts: Sequence[str], codes: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
        """``(place in texts, number of the indexed text, similarity)`` at or above the threshold."""
        counts = self.counts(texts, codes)
        whose, gram = np.nonzero(counts)
        x = counts[whose, gram] * self.idf[gram]
        norm = np.sqrt(np.bincount(whose, x * x, minlength=len(texts)))
        x /= norm[whose]
        lists = self.lists[gram]
        done = np.cumsum(lists)
        sums = np.zeros(len(texts) * self.texts)
        at = 0
        while at < len(gram):  # a run of grams whose lists together are of a bounded length
            end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + CELLS, "right")))
            n = lists[at:end]
            shift = np.repeat(self.begins[gram[at:end]] - (np.cumsum(n) - n), n)
            entry = shift + np.arange(len(shift))
            cell = np.repeat(whose[at:end] * self.texts, n) + self.text_of[entry]
            low, high = whose[at] * self.texts, (whose[end - 1] + 1) * self.texts
            sums[low:high] += np.bincount(cell - low, np.repeat(x[at:end], n) * self.weight[entry], minlength=high - low)
            at = end
        found = np.flatnonzero((sums >= threshold) & (sums > 0))
        return found // self.texts, found % self.texts, sums[found]

    def slices(self, texts: Sequence[str]) -> Iterator[tuple[int, int]]:
        """Runs of texts, bounded in characters and in cells."""
        most = max(1, CELLS // max(1, len(self.idf), self.texts))
        first = size = 0
        for i, text in enumerate(texts):
            if i > first and (size + len(text) > SLICE_CHARS or i - first >= most):
                yield first, i
                first, size = i, 0
            size += len(text)
        if first < len(texts):
            yield first, len(texts)

    def search(self, batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
        """Batches ``(id, name, lower)`` to batches ``(a_id, name, b, similarity)`` of the matches."""
        codes = self.codes()
        for batch in batches:
            for first, end in self.slices(batch.column(2).to_pylist()):
                part = batch.slice(first, end - first)
                place, number, similarity = self.matches(part.column(2).to_pylist(), codes, threshold)
                hits = part.take(pa.array(place, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [hits.column(0), hits.column(1), pa.array(number, pa.int64()), pa.array(similarity, pa.float64())],
                    ["a_id", "name", "b", "similarity"])
