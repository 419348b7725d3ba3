"""Language identification by a blended-spectrum string kernel, Nystroem landmarks and ridge regression."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starwright.llm.registry import query, table

SPECTRUM = 4  # grams of 1 to so many bytes
BITS = 16  # a gram is one of 2**BITS coordinates
SIZE = 1 << BITS
TRAIN_DOCS = 2000  # at most so many rows are fitted, shared evenly by the languages
MAX_LANGS = 100  # the most frequent languages that are learned
LANDMARKS = 256  # of the fitted rows
RIDGE = 1e-3
SHARPNESS = 6.0  # of the softmax that turns margins into a score
BATCH_DOCS, PIECE_BYTES = 64, 1 << 20
UNKNOWN = "und"
ODD = np.array([0, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)  # one multiplier per gram length
LETTER = re.compile("[A-Za-z]")
# letters of ASCII in lower case, all other ASCII as a blank, bytes of other characters as they are
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def raw(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(FOLD)


def has_letter(text: str | None) -> bool:
    return bool(text) and (LETTER.search(text) is not None or any(map(str.isalpha, text)))


def mark(flags: np.ndarray, pieces: list[bytes], rows: list[int]) -> None:
    """Set the coordinates of all grams of ``pieces`` in their rows of ``flags``."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), [len(p) for p in pieces])
    place = np.array(rows, np.int64)[owner] << BITS
    flat, gram = flags.reshape(-1), np.zeros(len(data), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(1, SPECTRUM + 1):
            count = len(data) - n + 1
            if count <= 0:
                break
            gram = (gram[:count] << np.uint32(8)) | data[n - 1:]
            inside = owner[n - 1:] == owner[:count]  # no gram spans two texts
            flat[(place[:count] + ((gram * ODD[n]) >> np.uint32(32 - BITS)))[inside]] = True


def presence(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """Which coordinates each text holds, as boolean rows, in batches of BATCH_DOCS texts.

    Whole texts count: a long one is marked piece by piece, with an overlap, in its one row. The
    array is reused by the next batch.
    """
    flags = np.zeros((BATCH_DOCS, SIZE), bool)
    pieces, rows, size, used = [], [], 0, 0
    for text in texts:
        body = b" " + raw(text) + b" "
        for at in range(0, max(1, len(body) - SPECTRUM + 1), PIECE_BYTES):
            piece = body[at:at + PIECE_BYTES + SPECTRUM - 1]
            pieces.append(piece)
            rows.append(used)
            size += len(piece)
            if size >= PIECE_BYTES:
                mark(flags, pieces, rows)
                pieces, rows, size = [], [], 0
        used += 1
        if used == BATCH_DOCS:
            if pieces:
                mark(flags, pieces, rows)
                pieces, rows, size = [], [], 0
            yield flags
            flags[:] = False
            used = 0
    if used:
        if pieces:
            mark(flags, pieces, rows)
        yield flags[:used]


@dataclass
class KernelModel:
    """Ridge weights carried back to the coordinates of the kernel.

    The kernel of texts x and z is the number of grams both hold over the root of the product of
    their numbers of grams. Kernel values against the landmarks times the ridge weights is
    ``(P_x P_landmarks') A``; the two matrices on the right do not depend on x and are multiplied once.
    """

    langs: list[str]
    weights: np.ndarray  # SIZE x languages
    bias: np.ndarray

    def margins(self, flags: np.ndarray) -> np.ndarray:
        """One row of margins per row of presence, by a sparse times a dense matrix."""
        held = np.flatnonzero(flags)
        count = np.bincount(held >> BITS, minlength=len(flags))
        starts = np.cumsum(count) - count
        sums = np.add.reduceat(self.weights[held & (SIZE - 1)], starts, axis=0)
        return sums / np.sqrt(count)[:, None] + self.bias


def fit(bits: list[bytes], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel:
    """One-versus-rest kernel ridge regression on Nystroem features of ``landmarks`` of the rows.

    ``bits`` are rows of presence, packed. The rows come in an order that mixes the languages, the first
    are the landmarks. Every language weighs the same.
    """
    names = sorted(set(langs))
    target = np.array([[1.0 if lang == name else -1.0 for name in names] for lang in langs])
    share = np.array([langs.count(lang) for lang in langs], float)
    cost = len(langs) / len(names) / share

    def unpacked(some: list[bytes]) -> np.ndarray:
        rows = np.unpackbits(np.frombuffer(b"".join(some), np.uint8)).reshape(len(some), SIZE).astype(np.float32)
        return rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))

    marks = unpacked(bits[:landmarks])
    kernel = np.concatenate([unpacked(bits[i:i + 64]) @ marks.T for i in range(0, len(bits), 64)]).astype(float)
    values, vectors = np.linalg.eigh(kernel[:len(marks)])
    kept = values > 1e-6 * values[-1]
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    features = np.hstack([kernel @ whiten, np.ones((len(bits), 1))])
    weighted = features * cost[:, None]
    gram = features.T @ weighted + ridge * len(bits) * np.diag([*[1.0] * kept.sum(), 0.0])
    solved = np.linalg.lstsq(gram, weighted.T @ target, rcond=None)[0]
    return KernelModel(names, (marks.T @ (whiten @ solved[:-1])).astype(np.float32), solved[-1])


def held_out(id_col: str) -> Column:
    """Rows that never teach: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, max_docs: int = TRAIN_DOCS, max_langs: int = MAX_LANGS) -> KernelModel | None:
    """A model from at most ``max_docs`` rows with a language that are not held out; None without any.

    The ``max_langs`` most frequent languages share the rows evenly. Rows are chosen by a hash of the id: first
    about twice as many as needed of each language, by a threshold, then the first of these, so no
    language is ever gathered in one task. Whole texts become rows of presence where they are; only these,
    of 8 kB each, come to the driver. Of rows of one id and language one counts.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    usable = usable.select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang"), F.col("text").alias("__text"))
    langs = usable.groupBy("__lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "__lang").limit(max_langs).collect()
    if not langs:
        return None
    each = max(1, max_docs // len(langs))
    shares = F.create_map(*[F.lit(v) for r in langs for v in (r["__lang"], min(1.0, 2.0 * each / r["n"]))])
    spot = F.xxhash64("__id")
    drawn = usable.where(F.pmod(spot, F.lit(1 << 30)) < F.element_at(shares, F.col("__lang")) * float(1 << 30))
    first = Window.partitionBy("__lang").orderBy("__spot", "__id")
    chosen = (
        drawn.select("__id", "__lang", spot.alias("__spot")).distinct()
        .withColumn("__rank", F.row_number().over(first)).where(F.col("__rank") <= each))

    def packed(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = [row.tobytes() for flags in presence(batch.column(3).to_pylist()) for row in np.packbits(flags, axis=1)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(3)], pa.array(rows, pa.binary())], ["__id", "__lang", "__rank", "bits"])

    kind = usable.schema["__id"].dataType.simpleString()
    found = (  # max_docs rows of three narrow columns
        usable.join(F.broadcast(chosen), ["__id", "__lang"]).select("__id", "__lang", "__rank", "__text")
        .mapInArrow(packed, f"__id {kind}, __lang string, __rank int, bits binary")
        .groupBy("__id", "__lang", "__rank").agg(F.min("bits").alias("bits"))
        .orderBy("__rank", "__lang").collect())
    return fit([r["bits"] for r in found], [r["__lang"] for r in found])


def identify_language(docs: DataFrame, max_docs: int = TRAIN_DOCS, max_langs: int = MAX_LANGS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, by its whole text.

    The model learns from ``lang`` of rows that are not held out (see :func:`train`) and sees nothing but the
    text when it predicts. ``lang_pred`` is the language of the largest margin, the first by name if equal, and
    ``score`` its softmax share. A text that is NULL or has no letter gives ``und`` and 0, and so does
    every text if there is nothing to learn from. Rows with a NULL id never teach and are not held out;
    repeated rows get equal answers; other columns are ignored; an empty table gives no rows. Scoring
    is one pass without a shuffle, over batches of texts and pieces of long ones.
    """
    model = train(docs, max_docs, max_langs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = batch.column(2).to_pylist()
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            asked = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
            done = 0
            for flags in presence(texts[i] for i in asked):
                margins = model.margins(flags)
                best = margins.argmax(1)
                parts = np.exp(SHARPNESS * (margins - margins.max(1, keepdims=True)))
                for i, k, share in zip(asked[done:done + len(flags)], best, 1 / parts.sum(1)):
                    langs[i], scores[i] = model.langs[k], share
                done += len(flags)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"),
                       F.col("text").alias("__text"))
    return rows.mapInArrow(batches, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


@query("op13_string_kernel_lang")
def op13_string_kernel_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))
