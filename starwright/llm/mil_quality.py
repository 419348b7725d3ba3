"""Quality classifier: gated-attention multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starwright.llm.common import bounded_batches
from starwright.llm.registry import query, table
from starwright.llm.words import text_slices, word_hashes

PASSAGE_BYTES = 400
KINDS = 12  # classes of bytes
FEATURES = KINDS * KINDS + KINDS + 6
HIDDEN, ATTENTION = 16, 8
TRAIN_DOCS = 4000  # at most so many labelled documents are fitted
EPOCHS, RATE, BATCH, DECAY = 40, 0.01, 64, 1e-3
SEED = 11


def byte_kinds() -> np.ndarray:
    """Class of each byte: lower, upper, digit, blank, line end, stop, quote, bracket, mark, symbol, high."""
    kind = np.full(256, 9, np.int32)
    kind[128:] = 10
    kind[192:] = 11
    for chars, k in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2),
                     (b" \t", 3), (b"\n\r\x0b\x0c", 4), (b".,;:", 5), (b"'\"`", 6), (b"()[]{}<>", 7), (b"!?", 8)):
        kind[list(chars)] = k
    return kind


KIND = byte_kinds()


def passages(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(features, document)`` of every passage of the texts; an empty text has one empty passage.

    A passage is a run of about PASSAGE_BYTES. Its features are the shares of byte classes and of
    pairs of neighbouring classes, and how often words repeat in it and in the document.
    """
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    most = max(len(data), (len(raws) + len(data) // PASSAGE_BYTES) * KINDS**2)
    whole = np.int32 if most < 1 << 31 else np.int64  # half the memory, where numbers fit
    lengths = np.array([len(r) + 1 for r in raws], whole)
    begins = np.cumsum(lengths, dtype=whole) - lengths
    pieces = np.maximum(1, -(-(lengths - 1) // PASSAGE_BYTES))
    document = np.repeat(np.arange(len(raws)), pieces)
    number = np.arange(len(document)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    owner_doc = np.repeat(np.arange(len(raws), dtype=whole), lengths)
    inside = np.arange(len(data), dtype=whole) - begins[owner_doc]
    width = -(-np.maximum(lengths - 1, 1) // pieces)  # passages of a text are equally long
    first = np.cumsum(pieces, dtype=whole) - pieces
    owner = first[owner_doc] + np.minimum(inside // width[owner_doc], pieces[owner_doc] - 1)
    k, count = KIND[data], len(document)
    single = np.bincount(owner * KINDS + k, minlength=count * KINDS).reshape(count, KINDS)
    inner = owner_doc[:-1] == owner_doc[1:]  # the byte after a text belongs to the next one
    pair = np.bincount((owner[:-1] * KINDS**2 + k[:-1] * KINDS + k[1:])[inner],
                       minlength=count * KINDS**2).reshape(count, -1)
    size = np.maximum(single.sum(1, keepdims=True), 1)
    words, _ = word_hashes(raws)
    extra = np.zeros((count, 6))
    extra[:, 3] = np.minimum(size[:, 0] / 10, 3)  # as for a passage without words among others
    if len(words):
        space = np.isin(k, (3, 4))
        starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        word_passage = owner[starts]  # the same words, in the same order
        n = np.bincount(word_passage, minlength=count)
        mixed = words ^ (word_passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        distinct = np.bincount(word_passage[np.unique(mixed, return_index=True)[1]], minlength=count)
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (word_passage[1:] == word_passage[:-1])
        safe = np.maximum(n, 1)
        extra[:, 0] = distinct / safe
        extra[:, 1] = np.bincount(word_passage, same, minlength=count) / safe
        extra[:, 2] = np.log1p(n) / 5
        extra[:, 3] = np.minimum(size[:, 0] / safe / 10, 3)
    extra[:, 4] = np.log1p(lengths[document]) / 10
    extra[:, 5] = number == 0
    return np.hstack([np.sqrt(pair / size), single / size, extra]).astype(np.float32), document


@dataclass
class MilModel:
    """Passage encoder, gated attention and a logistic output.

    ``h = tanh(x W + b)``; weights of a document's passages are the softmax of
    ``(tanh(h V) * sigmoid(h U)) w``; the score is the sigmoid of the weighted mean of h times c.
    """

    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, document: np.ndarray, count: int) -> dict[str, np.ndarray]:
        p = self.weights
        x = (x - p["mean"]) / p["scale"]
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = np.exp(np.clip((t * g) @ p["w"], -30, 30))
        a = e / np.bincount(document, e, minlength=count)[document]
        z = np.stack([np.bincount(document, a * h[:, i], minlength=count) for i in range(h.shape[1])], 1)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "logit": z @ p["c"] + p["d"]}

    def score(self, raws: list[bytes]) -> np.ndarray:
        x, document = passages(raws)
        logit = self.forward(x, document, len(raws))["logit"]
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def fit(raws: list[bytes], labels: np.ndarray, seed: int = SEED) -> MilModel:
    """Learn from documents and their labels by Adam on the balanced log loss."""
    rng = np.random.default_rng(seed)
    parts = [passages([r]) for r in raws]
    features = np.concatenate([x for x, _ in parts])
    p = {"mean": features.mean(0), "scale": features.std(0) + 0.05,
         "W": rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN),
         "V": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "U": rng.normal(0, 0.3, (HIDDEN, ATTENTION)),
         "w": rng.normal(0, 0.3, ATTENTION), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1)}
    model, names = MilModel(p), ["W", "b", "V", "U", "w", "c", "d"]
    first, second = ({n: np.zeros_like(p[n]) for n in names} for _ in range(2))
    share = labels.mean()
    cost = np.where(labels == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS) + 1e-4
        for chunk in np.array_split(rng.permutation(len(raws)), max(1, len(raws) // BATCH)):
            x = np.concatenate([parts[i][0] for i in chunk])
            document = np.repeat(np.arange(len(chunk)), [len(parts[i][0]) for i in chunk])
            f = model.forward(x, document, len(chunk))
            err = (1 / (1 + np.exp(-f["logit"])) - labels[chunk]) * cost[chunk] / len(chunk)
            dz = err[:, None] * p["c"]
            dzp = dz[document]
            pull = (dzp * f["h"]).sum(1)
            ds = f["a"] * (pull - np.bincount(document, f["a"] * pull, minlength=len(chunk))[document])
            dt = ds[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
            dg = ds[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
            dh = f["a"][:, None] * dzp + dt @ p["V"].T + dg @ p["U"].T
            dp = dh * (1 - f["h"] ** 2)
            grads = {"W": f["x"].T @ dp + DECAY * p["W"], "b": dp.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
                     "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ err, "d": np.array([err.sum()])}
            step += 1
            for n in names:
                first[n] = 0.9 * first[n] + 0.1 * grads[n]
                second[n] = 0.999 * second[n] + 0.001 * grads[n] ** 2
                p[n] = p[n] - rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(id_col: str) -> Column:
    """Rows that never teach: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS) -> MilModel | float:
    """A model from at most ``max_docs`` labelled rows that are not held out, chosen by a hash of the id.

    The sample is bounded, so its texts may come to the driver. Without both classes the share of
    good labels (one half without any) stands in for a model.
    """
    usable = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out("doc_id"))
    chosen = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.max("quality").alias("quality"), F.max("text").alias("text")).orderBy("doc_id").collect()
    marks = np.array([float(r["quality"]) for r in found])
    if len(set(marks)) < 2:
        return float(marks.mean()) if len(marks) else 0.5
    return fit([(r["text"] or "").encode() for r in found], marks)


def score_quality(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_docs: int = TRAIN_DOCS,
    carry: list[str] | None = None,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, by its whole text.

    Only the text is an input of the score. Labels of held-out rows are never read into the
    model. NULL and empty texts are scored as one empty passage; NULL ids are scored and not
    held out; repeated rows get equal scores; other columns are passed on if named in ``carry``, else ignored; an
    empty table gives no rows. Scoring is one pass without a shuffle; the model, some kilobytes,
    goes out with the tasks.
    """
    bounded_batches(docs.sparkSession)
    carry = carry or []
    others = [c for c in carry if c != "text"]  # the text goes to the workers once
    model = train(docs, labels, max_docs)
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}

    def batches(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raws in text_slices(source, 2):
            scores = np.full(len(raws), model) if isinstance(model, float) else model.score(raws)
            columns = [batch.column(0), batch.column(1), pa.array(scores, pa.float64()),
                       pa.array((scores >= threshold).astype(np.int32))]
            given = {"text": batch.column(2)} | {c: batch.column(3 + i) for i, c in enumerate(others)}
            yield pa.RecordBatch.from_arrays(
                [*columns, *[given[c] for c in carry]], ["doc_id", "held_out", "score", "predicted", *carry])

    schema = ", ".join([f"doc_id {fields['doc_id']}", "held_out boolean", "score double", "predicted int",
                        *[f"`{c}` {fields[c]}" for c in carry]])
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), F.col("text").alias("__text"),
                       *[F.col(c) for c in others])
    return rows.mapInArrow(batches, schema)


@query("op6_mil_quality")
def op6_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
