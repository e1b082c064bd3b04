"""Text quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rainledger.llm.samples import held_out, labelled
from rainledger.llm.tables import documents, keep_texts, labels
from rainledger.llm.words import remember_only, utf8_rows, windows, word_hashes

#: Labelled documents that the model is fitted on, at most.
TRAIN_ROWS = 4000
PASSAGE_WORDS = 64
HIDDEN = 32
EPOCHS = 30
ACCEPT = 0.3
SEED = 2

_NAMED = b" \n.,|!#&%$*"
_KINDS = 16


def _kind_table() -> np.ndarray:
    """Kind of each byte: the named ones, lower case, upper case, digit, beyond ASCII, all others."""
    table = np.full(256, 15, np.int64)
    table[ord("a") : ord("z") + 1] = 11
    table[ord("A") : ord("Z") + 1] = 12
    table[ord("0") : ord("9") + 1] = 13
    table[128:] = 14
    for kind, byte in enumerate(_NAMED):
        table[byte] = kind
    return table


_KIND = _kind_table()
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
INPUTS = _KINDS + _KINDS * _KINDS + 3


def passages(text: bytes) -> np.ndarray:
    """One row of inputs per passage of a text: shares of byte kinds and of their pairs, how much of the passage
    stands in the text more than once, word length, and passage length. An empty text is one empty passage."""
    if not text.strip():
        return np.zeros((1, INPUTS), np.float32)
    raw = np.frombuffer(text, np.uint8)
    blank = _BLANK[raw]
    starts = ~blank & np.r_[True, blank[:-1]]
    word = np.maximum(np.cumsum(starts) - 1, 0)
    passage = word // PASSAGE_WORDS
    count = int(passage[-1]) + 1
    kind = _KIND[raw]
    single = np.bincount(passage * _KINDS + kind, minlength=count * _KINDS).reshape(count, _KINDS)
    pair = (passage[1:] * _KINDS + kind[:-1]) * _KINDS + kind[1:]
    pairs = np.bincount(pair, minlength=count * _KINDS**2).reshape(count, -1)
    sizes = single.sum(axis=1, keepdims=True)
    words = np.bincount(word[starts] // PASSAGE_WORDS, minlength=count)[:, None]
    runs = windows(word_hashes(text), 4)
    again = np.zeros((count, 1))
    if len(runs):
        _, which, times = np.unique(runs, return_inverse=True, return_counts=True)
        again[:, 0] = np.bincount(np.arange(len(runs)) // PASSAGE_WORDS, times[which] > 1, minlength=count)[:count]
    rest = [again / np.maximum(words, 1), sizes / np.maximum(words, 1) / 20, np.log1p(words) / 4]
    return np.concatenate([np.sqrt(single / sizes), np.sqrt(pairs / sizes), *rest], axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Passage encoder, gated attention over a document's passages, and a score of their weighted mean."""

    NAMES = ("encode", "encode_bias", "tanh_gate", "sigmoid_gate", "attend", "score", "score_bias")

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts = parts

    @classmethod
    def new(cls, seed: int = SEED) -> AttentionModel:
        draw = np.random.RandomState(seed)

        def normal(*shape: int) -> np.ndarray:
            return draw.normal(0, 1 / np.sqrt(shape[0]), shape)

        shapes = [normal(INPUTS, HIDDEN), np.zeros(HIDDEN), normal(HIDDEN, HIDDEN), normal(HIDDEN, HIDDEN)]
        return cls(dict(zip(cls.NAMES, [*shapes, normal(HIDDEN), normal(HIDDEN), np.zeros(1)], strict=True)))

    def to_bytes(self) -> bytes:
        np.savez(out := io.BytesIO(), **{k: v.astype(np.float32) for k, v in self.parts.items()})
        return out.getvalue()

    @classmethod
    def of_bytes(cls, raw: bytes) -> AttentionModel:
        with np.load(io.BytesIO(raw)) as parts:
            return cls({k: parts[k].astype(np.float64) for k in cls.NAMES})

    def forward(self, x: np.ndarray, firsts: np.ndarray) -> dict[str, np.ndarray]:
        """``firsts``: index of the first passage of each document."""
        p, lengths = self.parts, np.diff(np.r_[firsts, len(x)])
        doc = np.repeat(np.arange(len(firsts)), lengths)
        h = np.tanh(x @ p["encode"] + p["encode_bias"])
        t, s = np.tanh(h @ p["tanh_gate"]), _sigmoid(h @ p["sigmoid_gate"])
        e = (t * s) @ p["attend"]
        e = np.exp(e - np.maximum.reduceat(e, firsts)[doc])
        a = e / np.add.reduceat(e, firsts)[doc]
        z = np.add.reduceat(a[:, None] * h, firsts)
        return {"doc": doc, "h": h, "t": t, "s": s, "a": a, "z": z, "score": _sigmoid(z @ p["score"] + p["score_bias"])}

    def gradients(self, x: np.ndarray, firsts: np.ndarray, label: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        p, f = self.parts, self.forward(x, firsts)
        d_logit = (f["score"] - label) / len(label)
        d_z = (d_logit[:, None] * p["score"])[f["doc"]]
        d_a = (d_z * f["h"]).sum(axis=1)
        d_e = f["a"] * (d_a - np.add.reduceat(f["a"] * d_a, firsts)[f["doc"]])
        d_t = d_e[:, None] * p["attend"] * f["s"] * (1 - f["t"] ** 2)
        d_s = d_e[:, None] * p["attend"] * f["t"] * f["s"] * (1 - f["s"])
        d_h = f["a"][:, None] * d_z + d_t @ p["tanh_gate"].T + d_s @ p["sigmoid_gate"].T
        d_pre = d_h * (1 - f["h"] ** 2)
        found = {
            "encode": x.T @ d_pre,
            "encode_bias": d_pre.sum(axis=0),
            "tanh_gate": f["h"].T @ d_t,
            "sigmoid_gate": f["h"].T @ d_s,
            "attend": (f["t"] * f["s"]).T @ d_e,
            "score": f["z"].T @ d_logit,
            "score_bias": np.array([d_logit.sum()]),
        }
        return {k: v + decay * p[k] for k, v in found.items()}


def fit(bags: list[np.ndarray], label: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> AttentionModel:
    """Adam on the log loss; the order of documents is drawn from the seed, so equal samples give equal models."""
    model, draw = AttentionModel.new(seed), np.random.RandomState(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.parts.items()}
    step = 0
    for epoch in range(epochs):
        order = draw.permutation(len(bags))
        for low in range(0, len(order), 64):
            batch = order[low : low + 64]
            x = np.concatenate([bags[i] for i in batch]).astype(np.float64)
            lengths = np.array([len(bags[i]) for i in batch])
            grads = model.gradients(x, np.cumsum(lengths) - lengths, label[batch], 1e-4)
            step += 1
            rate = 0.01 * 0.9**epoch
            for k, g in grads.items():
                first, second = moments[k]
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                model.parts[k] -= rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels_table: DataFrame, column: str = "quality", rows: int = TRAIN_ROWS) -> bytes:
    """The model fitted on at most ``rows`` labelled documents, whole texts; its size doesn't depend on the data.

    Passages are encoded where the documents lie; one task gets the inputs of the sample. Empty without labels.
    """
    chosen = F.broadcast(labelled(labels_table, column, rows))  # at most ``rows`` ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember_only()
        for batch in batches:
            bags = [passages(text) for text in utf8_rows(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.string()), batch.column("label"), pa.array([b.tobytes() for b in bags], pa.binary())],
                names=["doc_id", "label", "bag"],
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        raw = b""
        if rows:
            bags = [np.frombuffer(bag, np.float32).reshape(-1, INPUTS) for _, _, bag in rows]
            raw = fit(bags, np.array([float(y) for _, y, _ in rows])).to_bytes()
        yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["model"])

    sample = keep_texts(
        docs.select("doc_id", "text").join(chosen, "doc_id").mapInArrow(encode, "doc_id string, label int, bag binary"),
        "passage-sample",
    )
    return b"".join(bytes(row["model"]) for row in sample.repartition(1).mapInArrow(learn, "model binary").collect())


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, from its text alone.

    - NULL, empty and blank texts are one empty passage, scored like any other.
    - Without a model (no labels to learn from) every score is 0.5.
    - A NULL doc_id stays NULL and isn't held out; repeated rows are scored each; an empty table gives no rows.
    - Further columns are not read, whatever their names.
    """
    return scored(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= ACCEPT).cast("int").alias("predicted"),
    )


def scored(docs: DataFrame, model: bytes) -> DataFrame:
    """The rows with quality_score; an input column of that name gives way."""
    docs = docs.drop("quality_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember_only()
        fitted = AttentionModel.of_bytes(model) if model else None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                bags = [passages(text) for text in utf8_rows(part.column("text"))]
                lengths = np.array([len(b) for b in bags])
                found = np.full(len(bags), 0.5)
                if fitted:
                    found = fitted.forward(np.concatenate(bags), np.cumsum(lengths) - lengths)["score"]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], names=[*part.schema.names, "quality_score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("quality_score", DoubleType())]))


def op2_quality_mil(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, labels(spark, sf_dir)))
