"""BPE encoding and decoding by forced-boundary splitting."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import add
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from starwright.llm.common import bounded_batches
from starwright.llm.registry import query, table
from starwright.llm.words import give_back

WORD_CACHE = 600_000  # entries of each cache of a Python worker; a full one is emptied
CACHE_BYTES = 32 << 20  # of keys and values in each cache; one that would pass it is emptied
ENTRY_BYTES = 50  # of the table itself for each entry, about
OBJECT_BYTES = 90  # of a short text and of bytes, beside what they hold
LONGEST = 64  # characters of what is remembered; longer pieces are worked out each time
TOGETHER = 100  # unknown pieces given to the model at once
# the white space of the tokenizer's pattern language, written out
SPACES = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# fixed values: the split pattern, for text of Latin letters, and the byte alphabet of byte-level BPE vocabularies. Which
# characters beyond are letters or numbers depends on the Unicode version, so the library itself splits text that holds them.
LATIN_END = "\u0250"  # the letters and numbers before it are settled
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_SPACES = r"\t\n\x0b\x0c\r \x85\xa0"
PIECE = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{LATIN_SPACES}{LETTERS}{NUMBERS}]+"
    rf"|[{LATIN_SPACES}]+(?![^{LATIN_SPACES}])|[{LATIN_SPACES}]+")
LATIN_WORD = re.compile(f"[{LETTERS}]+").fullmatch
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
# a chunk is a run of white space and what follows up to the next; no token spans two chunks
CHUNK = re.compile(rf"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
RARE_SPACES = [*"\x85\xa0\u1680", *map(chr, range(0x2000, 0x200B)), *"\u2028\u2029\u202f\u205f\u3000"]
SPACE_PAIRS = ["  ", *[pair for c in "\t\n\x0b\x0c\r" for pair in (c + " ", " " + c)]]
MARKS = set(".,;:!?")
CUT = "\ue000"  # ends a Latin text, which does not hold it
NO_BYTE = 0xFF  # occurs in no UTF-8 text
KINDS = np.zeros(1 << 16, np.uint8)  # of characters of Latin text
KINDS[[i for i in range(ord(LATIN_END)) if re.match(f"[{LATIN_SPACES}]", chr(i))]] = WHITE = 1
KINDS[[i for i in range(ord(LATIN_END)) if re.match(f"[{LETTERS}]", chr(i))]] = 2
KINDS[[i for i in range(ord(LATIN_END)) if re.match(f"[{NUMBERS}]", chr(i))]] = 3
KINDS[ord(CUT)] = LAST = 4


def odd_spaces(text: str) -> bool:
    """Whether a space stands beside other white space or at the end, or white space beyond ASCII occurs.

    Otherwise each space belongs to the word that follows it.
    """
    return (text[-1:].isspace() or any(pair in text for pair in SPACE_PAIRS)
            or not text.isascii() and any(c in text for c in RARE_SPACES))


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")  # faster than to look for the largest character
        return True
    except UnicodeEncodeError:
        return max(text) < LATIN_END


def piece_starts(codes: np.ndarray) -> np.ndarray:
    """Where the pieces of PIECE start in Latin texts that CUT ends, each CUT being one; ``codes`` are characters."""
    kind = KINDS[codes]
    start = np.ones(len(codes), bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == LAST)
    # the last white space before a word is apart from more before it, and a space begins that word
    last = np.flatnonzero((kind[:-1] == WHITE) & (kind[1:] != WHITE) & (kind[1:] != LAST))
    start[last] = True
    start[last + 1] = codes[last] != ord(" ")
    quote = np.flatnonzero(start & (codes == ord("'")))
    for ending in ("s", "t", "re", "ve", "m", "ll", "d"):
        at = quote[quote + len(ending) < len(codes)]
        for i, c in enumerate(ending, 1):
            at = at[codes[at + i] == ord(c)]
        start[at + 1] = False
        start[at + 1 + len(ending)] = True
    return np.flatnonzero(start)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printed, else the next free from 256."""
    letters, free = {b: chr(b) for b in PRINTED}, 256
    for b in range(256):
        if b not in letters:
            letters[b], free = chr(free), free + 1
    return [letters[b] for b in range(256)]


class Remembered(dict):
    """Values of a function, worked out when first asked for; those of short keys are kept.

    At most ``limit`` entries of together ``most`` bytes are held, whichever is reached first.
    """

    def __init__(self, function, limit: int, most: int = CACHE_BYTES):
        super().__init__()
        self.function, self.limit, self.most, self.held = function, limit, most, 0

    def __missing__(self, key):
        value = self.function(key)
        if len(key) <= LONGEST:
            size = getsizeof(key) + getsizeof(value) + ENTRY_BYTES
            if len(self) >= self.limit or self.held + size > self.most:
                self.forget()
            self.held += size
            self[key] = value
        return value

    def add(self, found: dict, size: int) -> None:
        """Keep values of short keys that were worked out elsewhere, of about so many bytes."""
        if len(self) + len(found) > self.limit or self.held + size > self.most:
            self.forget()
        self.held += size
        self.update(found)

    def forget(self) -> None:
        self.clear()
        self.held = 0


class PieceEncoder:
    """Ids of a byte-level BPE vocabulary by the tokenizers library's model, each distinct piece once.

    The model merges inside the pieces of the split pattern only, so the ids of a text are those
    of its pieces, one after the other. White space always starts a piece, hence whole
    words can be looked up. Strings of special tokens are taken out first, as the library does. Caches are
    bounded in entries, in bytes and in the length of their keys, also within one text.
    """

    def __init__(self, path: str, cache: int = WORD_CACHE):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenize = self.tokenizer.model.tokenize
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        vocabulary = spec["model"]["vocab"]
        self.merges_only = not any(spec["model"].get(option) for option in (
            "ignore_merges", "dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        letters = byte_alphabet()
        self.to_letters = {b: letters[b] for b in range(256)}
        self.space = letters[32]
        to_byte = {c: b for b, c in enumerate(letters)}
        self.vocabulary = vocabulary
        self.id_bytes = [i.to_bytes(4, "little") for i in range(1 + max(
            [*vocabulary.values(), *self.added.values()]))]
        self.token_bytes = {i: bytes(to_byte[c] for c in t) for t, i in vocabulary.items()}
        self.token_bytes.update({i: t.encode() for t, i in self.added.items()})
        longest_first = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest_first))) if self.added else None
        self.limit = cache
        self.presplit = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.words = Remembered(self.encode_word, cache)  # what follows one space, without that space
        self.pieces = Remembered(self.encode_letters, cache)  # in the byte alphabet
        self.chunks = Remembered(lambda c: b"".join(map(self.pieces.__getitem__, self.split(c))), cache)

    def forget(self) -> None:
        """Empty all caches."""
        for cache in vars(self).values():
            if isinstance(cache, Remembered):
                cache.forget()

    def split(self, text: str) -> list[str]:
        """The pieces of a text in the byte alphabet."""
        if text.isascii():
            return [p.translate(self.to_letters) for p in PIECE.findall(text)]
        if max(text) < LATIN_END:
            return [self.letters(p) for p in PIECE.findall(text)]
        return [p for p, _ in self.presplit(text)]

    def letters(self, piece: str) -> str:
        """The bytes of a piece in the byte alphabet."""
        return piece.encode("utf-8").decode("latin-1").translate(self.to_letters)

    def encode_letters(self, letters: str) -> bytes:
        ids, tokens = self.id_bytes, self.tokenize(letters)
        return ids[tokens[0].id] if len(tokens) == 1 else b"".join([ids[t.id] for t in tokens])

    def encode_word(self, word: str) -> bytes:
        if word.isascii():
            if word.isalpha():  # letters after one space are one piece
                return self.encode_letters(self.space + word)
            if word[-1] in MARKS and word[:-1].isalpha():
                return self.words[word[:-1]] + self.pieces[word[-1]]
        elif LATIN_WORD(word):
            return self.encode_letters(self.space + self.letters(word))
        elif word[-1] in MARKS and LATIN_WORD(word[:-1]):
            return self.words[word[:-1]] + self.pieces[word[-1]]
        return b"".join(map(self.pieces.__getitem__, self.split(" " + word)))

    def encode_plain(self, text: str) -> bytes:
        if odd_spaces(text):
            return b"".join(map(self.chunks.__getitem__, CHUNK.findall(text)))
        head, *words = text.split(" ")
        return self.chunks[head] + b"".join(map(self.words.__getitem__, words))

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        if not self.special or not self.special.search(text):
            return self.encode_plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self.encode_plain(text[at:m.start()]), self.id_bytes[self.added[m[0]]]]
            at = m.end()
        return b"".join([*out, self.encode_plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        table = self.token_bytes
        return b"".join(map(table.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


class ForcedBoundaryEncoder(PieceEncoder):
    """The same ids by forced-boundary splitting.

    Merging never joins two bytes that stand side by side in no vocabulary token, for the joined
    token would hold that pair. So each such pair is a certain cut: the fragments between cuts
    are encoded on their own, each distinct one once, and their ids concatenated.
    """

    def __init__(self, path: str, cache: int = WORD_CACHE):
        super().__init__(path, cache)
        self.joined = {t[i:i + 2] for t in self.vocabulary for i in range(len(t) - 1)}
        self.fragments = Remembered(super().encode_letters, cache)

    def cut(self, letters: str) -> list[str]:
        """Fragments between certain cuts."""
        joined = self.joined
        if joined.issuperset(map(add, letters, letters[1:])):
            return [letters]
        ends = [i for i, pair in enumerate(map(add, letters, letters[1:]), 1) if pair not in joined]
        return [letters[a:b] for a, b in zip([0, *ends], [*ends, len(letters)])]

    def encode_letters(self, letters: str) -> bytes:
        fragments = self.cut(letters)
        if len(fragments) == 1:  # the caller remembers the whole piece
            return super().encode_letters(letters)
        return b"".join(map(self.fragments.__getitem__, fragments))


class BatchEncoder(PieceEncoder):
    """The same ids for many texts at once: each distinct piece of them is looked up once, and pieces that are
    not remembered go to the model many at a time.

    The letter of a byte that no UTF-8 text holds stands between those. It is in no other token, so nothing is
    merged across it. Where a vocabulary has no such letter, or options beside merges, pieces go one by one.
    """

    def __init__(self, path: str, cache: int = WORD_CACHE):
        super().__init__(path, cache)
        self.end = self.vocabulary.get(self.to_letters[NO_BYTE])
        alone = "".join(self.vocabulary).count(self.to_letters[NO_BYTE]) == 1
        self.joins = self.merges_only and alone and self.end is not None

    def encode_unknown(self, pieces: list[str]) -> list[bytes]:
        """Ids of short pieces of Latin text; all are remembered."""
        out, step = [], min(TOGETHER, self.limit)
        for at in range(0, len(pieces), step):
            some = pieces[at:at + step]
            if self.joins:
                raw = (CUT.join(some) + CUT).encode("utf-8").replace(CUT.encode("utf-8"), bytes([NO_BYTE]))
                tokens = self.tokenize(raw.decode("latin-1").translate(self.to_letters))
                ids = np.array([t.id for t in tokens], "<u4")
                ends, joined = (4 * np.flatnonzero(ids == self.end)).tolist(), ids.tobytes()
                coded = [joined[a:b] for a, b in zip([0, *[e + 4 for e in ends[:-1]]], ends)]
            else:
                coded = [self.encode_letters(self.letters(p)) for p in some]
            size = sum(map(len, some)) + sum(map(len, coded)) + len(some) * (OBJECT_BYTES + ENTRY_BYTES)
            self.chunks.add(dict(zip(some, coded, strict=True)), size)
            out += coded
        return out

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces of Latin text."""
        out = list(map(self.chunks.get, pieces))
        unknown = [i for i, v in enumerate(out) if v is None]
        short = [i for i in unknown if len(pieces[i]) <= LONGEST]
        for i, coded in zip(short, self.encode_unknown([pieces[i] for i in short]), strict=True):
            out[i] = coded
        for i in unknown:
            if len(pieces[i]) > LONGEST:
                out[i] = self.encode_letters(self.letters(pieces[i]))
        return out

    def encode_all(self, texts: list[str], end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """``(counts, ids)``: how many ids each whole text has, ``end`` appended, and all of them in order."""
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, "<u4")
        others = {i: self.encode(t) + end for i, t in enumerate(texts)
                  if not is_latin(t) or self.special and self.special.search(t)}
        text = CUT.join(["" if i in others else t for i, t in enumerate(texts)]) + CUT
        codes = np.frombuffer(text.encode("utf-16-le"), "<u2")
        starts = piece_starts(codes)
        width = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800)  # in UTF-8
        edges = np.concatenate([[0], np.cumsum(np.add.reduceat(width, starts, dtype=np.int64))])
        pieces = pa.LargeStringArray.from_buffers(
            len(starts), pa.py_buffer(edges), pa.py_buffer(text.encode("utf-8"))).dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        whole = distinct.index(CUT)
        distinct[whole] = ""  # the text's end, no piece
        coded = self.encode_pieces(distinct)
        coded[whole] = end
        order = pieces.indices.to_numpy().astype(np.int64)
        lasts = np.flatnonzero(order == whole)
        order[lasts[list(others)]] = np.arange(len(coded), len(coded) + len(others))
        taken = pa.array([*coded, *others.values()], pa.large_binary()).take(pa.array(order))
        ends = np.frombuffer(taken.buffers()[1], "<i8", len(order) + 1)[lasts + 1] // 4
        ids = np.frombuffer(taken.buffers()[2], "<u4", ends[-1]) if ends[-1] else np.zeros(0, "<u4")
        return np.diff(ends, prepend=0), ids


@lru_cache(maxsize=2)
def encoder(path: str) -> ForcedBoundaryEncoder:
    """One encoder per worker process; made anew for each task it would leave more memory in pieces."""
    return ForcedBoundaryEncoder(path)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True,
) -> DataFrame:
    """Encode and decode every whole text.

    Returns ``id, n_tokens, ids_sha256, decoded_sha256`` and, with ``keep_ids``, ``ids`` (an
    array of integers) and ``decoded``. ``path`` is the vocabulary file, read by every worker. A
    NULL or empty text has no ids and decodes to the empty text. Rows are independent: nothing is
    shuffled, repeated rows and NULL ids stay as they are, other columns are ignored, and an
    empty table gives no rows. Texts of any length are encoded whole.
    """
    bounded_batches(df.sparkSession)
    schema = f"{id_col} {dict(df.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        schema += ", ids array<int>, decoded string"

    def batches(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in source:
            counts, coded, back, ids, texts = [], [], [], [], []
            for value in batch.column(1):
                raw = bpe.encode(value.as_py() or "")
                text = bpe.decode(raw)
                counts.append(len(raw) // 4)
                coded.append(hashlib.sha256(raw).hexdigest())
                back.append(hashlib.sha256(text.encode("utf-8")).hexdigest())
                if keep_ids:
                    ids.append(memoryview(raw).cast("I").tolist())
                    texts.append(text)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()),
                       pa.array(back, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)
        bpe.forget()  # a worker goes on to other stages, which need the memory
        give_back()

    return df.select(id_col, text_col).mapInArrow(batches, schema)


@query("op5_bpe_round_trip")
def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), vocabulary_path(), keep_ids=False)
