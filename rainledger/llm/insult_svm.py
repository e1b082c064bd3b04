"""Toxicity by a support vector machine on a gapped subsequence kernel with Nystroem landmarks."""

from __future__ import annotations

import io
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainledger.llm.samples import held_out, labelled
from rainledger.llm.tables import documents, keep, labels
from rainledger.llm.words import LOWER, utf8_rows

#: Labelled documents of each class that the model is fitted on, at most.
TRAIN_ROWS_PER_CLASS = 2500
LANDMARKS = 384
#: A step between letters of a subsequence is at most so long, and each place costs this factor.
STEP = 3
DECAY = 0.6
#: Letters of a unit; longer words are read in windows that overlap by half.
UNIT = 24
ROUNDS = 3
#: Word scores that a Python worker remembers; beyond that it starts anew.
CACHE_WORDS = 600_000
SEED = 8
TOXIC = 0.5
#: What makes a string typical of toxic sentences at first: its log odds, and these in standard errors.
LEAST_ODDS = 1.5
LEAST_SURE = 2.7
RIDGE = 2.0
#: The surest strings are learned with an inserted letter too, at this cost each.
GAPPED = 100
GAPPED_COST = 1.0
FEATURES = 5

_CODES = 64
_EDGE = 63
_SPELLED = re.compile(rb"(?<!\S)(?:\S\s){3,}\S(?!\S)")
_SENTENCE = re.compile(rb"(?<=[.!?])\s+|\n+")


def _code_table() -> np.ndarray:
    """a-z are 1 to 26, bytes after the first of a longer UTF-8 letter 27 to 58; all others are left out."""
    table = np.zeros(256, np.int64)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[128:192] = 27 + np.arange(64) % 32
    return table


_CODE = _code_table()
_DROP = bytes(b for b in range(256) if not _CODE[b])


def units(word: bytes) -> list[bytes]:
    """The letters of a lower-cased word, without what is inserted between them, in windows of UNIT letters."""
    letters = word.translate(None, _DROP)
    if len(letters) <= UNIT:
        return [letters] if len(letters) > 2 else []
    half = UNIT // 2
    return [letters[i : i + UNIT] for i in range(0, len(letters) - half, half)]


def words(text: bytes) -> set[bytes]:
    """The different words of a lower-cased text, with spelled-out ones (l o s e r) put together."""
    found = set(text.split())
    found.update(b"".join(run.split()) for run in _SPELLED.findall(text))
    return found


@cache
def _pattern(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (three rows) and weights of the subsequences of a string of so many letters, edges included.

    Weights are scaled to length one, so a longer word doesn't count more.
    """
    found = [
        (i, i + one, i + one + two, DECAY ** (one + two))
        for one in range(1, STEP + 1)
        for two in range(1, STEP + 1)
        for i in range(length - one - two)
    ]
    table = np.array(found).T
    return table[:3].astype(int), table[3] / np.sqrt((table[3] ** 2).sum())


def subsequences(given: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The three-letter subsequences of strings, gaps allowed, for strings of one length at a time: which strings,
    the keys of each (one row per string), and the weights (the same for all of them). The edges of a word count as letters."""
    lengths = np.array([len(u) for u in given])
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        codes = np.full((len(rows), length + 2), _EDGE, np.int32)
        codes[:, 1:-1] = _CODE[np.frombuffer(b"".join(given[i] for i in rows), np.uint8)].reshape(len(rows), length)
        places, weights = _pattern(int(length) + 2)
        first, second, third = (codes[:, p] for p in places)
        yield rows, (first * _CODES + second) * _CODES + third, weights


class KernelModel:
    """Decision values of words and documents.

    A gapped subsequence kernel has an explicit feature space, so the weights of the landmarks collapse into one
    weight per subsequence: sum of alpha(l) K(word, l) over landmarks = word features . weights.
    """

    def __init__(self, weights: np.ndarray, bias: float, platt: np.ndarray):
        self.weights, self.bias, self.platt = weights, bias, platt
        self.seen: dict[bytes, float] = {}

    def to_bytes(self) -> bytes:
        np.savez_compressed(out := io.BytesIO(), weights=self.weights.astype(np.float32), bias=self.bias, platt=self.platt)
        return out.getvalue()

    @classmethod
    def of_bytes(cls, raw: bytes) -> KernelModel:
        with np.load(io.BytesIO(raw)) as parts:
            return cls(parts["weights"], float(parts["bias"]), parts["platt"])

    def of_units(self, given: list[bytes]) -> np.ndarray:
        out = np.full(len(given), self.bias)
        for low in range(0, len(given), 8192):
            for rows, keys, weights in subsequences(given[low : low + 8192]):
                out[low + rows] += self.weights[keys] @ weights
        return out

    def of_words(self, given: list[bytes]) -> np.ndarray:
        """The best unit of each word; -2 for a word without three letters."""
        parts = [units(w) for w in given]
        owner = np.repeat(np.arange(len(given)), [len(p) for p in parts])
        out = np.full(len(given), -2.0)
        np.maximum.at(out, owner, self.of_units([u for p in parts for u in p]))
        return out

    def document_features(self, texts: list[bytes]) -> np.ndarray:
        """Per text: the decision values of its three highest different words, the sum of those above 0, and
        the logarithm of the number of words."""
        split = [words(t.translate(LOWER)) for t in texts]
        new = list(set().union(*split).difference(self.seen))
        if len(self.seen) + len(new) > CACHE_WORDS:
            self.seen.clear()
            new = list(set().union(*split))
        self.seen.update(zip(new, np.clip(self.of_words(new), -2, 2).tolist(), strict=True))
        out = np.full((len(texts), FEATURES), -2.0)
        out[:, 3:] = 0
        for row, found in enumerate(split):
            if found:
                values = np.fromiter(map(self.seen.__getitem__, found), np.float64, len(found))
                best = np.sort(np.partition(values, -3)[-3:] if len(values) > 3 else values)[::-1]
                out[row, : len(best)] = best
                out[row, 3] = np.log1p(np.maximum(values, 0).sum())
                out[row, 4] = np.log1p(len(found))
        return out

    def of_texts(self, texts: list[bytes]) -> np.ndarray:
        found = self.document_features(texts) @ self.platt[:FEATURES] + self.platt[FEATURES]
        return 1 / (1 + np.exp(-np.clip(found, -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float) -> np.ndarray:
    """Primal Newton steps for the squared hinge; the last weight is the bias, which isn't shrunk."""
    x = np.hstack([x, np.ones((len(x), 1))])
    shrink = ridge * np.eye(x.shape[1])
    shrink[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(20):
        on = y * (x @ w) < 1
        xs, cs = x[on], cost[on]
        new = np.linalg.solve(shrink + (xs * cs[:, None]).T @ xs, (xs * cs[:, None]).T @ y[on])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


class _Landmarks:
    def __init__(self, given: list[bytes]):
        parts = list(subsequences(given))
        self.used = np.unique(np.concatenate([keys.ravel() for _, keys, _ in parts]))
        self.index = np.full(_CODES**3, len(self.used))
        self.index[self.used] = np.arange(len(self.used))
        self.table = np.zeros((len(self.used) + 1, len(given)), np.float32)
        for rows, keys, weights in parts:
            np.add.at(self.table, (self.index[keys], rows[:, None]), weights[None, :])
        values, vectors = np.linalg.eigh(self.kernel(given))
        good = values > 1e-4 * values.max()
        self.map = vectors[:, good] / np.sqrt(values[good])

    def kernel(self, given: list[bytes]) -> np.ndarray:
        """K(string, landmark): products of the features that both have."""
        out = np.zeros((len(given), self.table.shape[1]))
        for low in range(0, len(given), 2048):
            for rows, keys, weights in subsequences(given[low : low + 2048]):
                found = self.index[keys]
                for j, weight in enumerate(weights):
                    live = np.flatnonzero(found[:, j] < len(self.used))
                    out[low + rows[live]] += weight * self.table[found[live, j]]
        return out

    def collapse(self, w: np.ndarray) -> np.ndarray:
        weights = np.zeros(_CODES**3)
        weights[self.used] = self.table[:-1] @ (self.map @ w)
        return weights


def _platt(x: np.ndarray, label: np.ndarray, cost: np.ndarray) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (cost * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        w = w - np.linalg.solve(hess, x.T @ (cost * (p - label)) + 1e-2 * w)
    return w


def _with_insert(unit: bytes, draw: np.random.RandomState) -> bytes:
    """A string with one more letter inside."""
    at = draw.randint(2, len(unit) - 1)
    return unit[:at] + bytes([draw.randint(ord("a"), ord("z") + 1)]) + unit[at:]


def _nothing_learned(toxic_share: float) -> KernelModel:
    odds = np.log(max(toxic_share, 1e-6) / max(1 - toxic_share, 1e-6))
    return KernelModel(np.zeros(_CODES**3), -2.0, np.r_[np.zeros(FEATURES), odds])


def fit(texts: list[bytes], label: np.ndarray, toxic_share: float, seed: int = SEED) -> KernelModel:
    """Learn from documents' labels which sentences, and in them which strings, are toxic.

    Every different sentence has its document's label. The strings that are far more frequent in toxic sentences
    are the first positives, each with its number of toxic sentences, and with its clean ones as negatives. A
    round trains the machine against strings of clean sentences, the highest of them always, and then takes rare
    strings of toxic sentences in by their decision values. A third of the documents only fit the final logistic curve.
    """
    draw = np.random.RandomState(seed)
    order = draw.permutation(len(texts))
    cut = len(texts) // 3
    curve, base = order[:cut], order[cut:]
    sentences: tuple[set[bytes], set[bytes]] = (set(), set())
    for i in base:
        sentences[int(label[i] > 0.5)].update(_SENTENCE.split(texts[i].translate(LOWER)))
    counts = (Counter(), Counter())
    for side in (0, 1):
        for sentence in sorted(sentences[side]):
            counts[side].update({u for w in words(sentence) for u in units(w)})
    vocabulary = sorted(set(counts[0]) | set(counts[1]))
    clean_in = np.array([counts[0][u] for u in vocabulary], float)
    toxic_in = np.array([counts[1][u] for u in vocabulary], float)
    rated = np.log((toxic_in + 0.5) / (len(sentences[1]) + 1)) - np.log((clean_in + 0.5) / (len(sentences[0]) + 1))
    sure = rated / np.sqrt(1 / (toxic_in + 0.5) + 1 / (clean_in + 0.5))
    typical = (rated > LEAST_ODDS) & (sure > LEAST_SURE)
    clean = np.flatnonzero(clean_in > 0)
    if not typical.any() or not len(clean):
        return _nothing_learned(toxic_share)
    surest = np.flatnonzero(typical)[np.argsort(-sure[typical], kind="stable")][:GAPPED]
    gapped = [_with_insert(vocabulary[i], draw) for i in surest for _ in range(3) if len(vocabulary[i]) > 4]
    chosen, value = typical, np.where(typical, 1.0, rated / 100)
    for _ in range(ROUNDS):
        positives = np.flatnonzero(chosen)
        hard = clean[np.argsort(-value[clean], kind="stable")[:4000]]
        against = np.unique(np.r_[hard, draw.choice(clean, min(len(clean), 12000), replace=False)])
        first = positives[np.argsort(-toxic_in[positives], kind="stable")][: LANDMARKS // 2]
        other = draw.choice(against, min(len(against), LANDMARKS - len(first)), replace=False)
        marks = _Landmarks([vocabulary[i] for i in [*first, *other]])
        rows = np.r_[positives, against]
        y = np.r_[np.ones(len(positives)), -np.ones(len(against))]
        cost = np.r_[np.minimum(toxic_in[positives], 20), np.minimum(clean_in[against], 20)]
        cost[: len(positives)] *= cost[len(positives) :].sum() / cost[: len(positives)].sum()
        given = [vocabulary[i] for i in rows] + gapped
        y, cost = np.r_[y, np.ones(len(gapped))], np.r_[cost / cost.mean(), np.full(len(gapped), GAPPED_COST)]
        w = _svm(marks.kernel(given) @ marks.map, y, cost, ridge=RIDGE)
        model = KernelModel(marks.collapse(w[:-1]), float(w[-1]), np.zeros(FEATURES + 1))
        value = model.of_units(vocabulary)
        chosen = typical | ((value > 0.5) & (toxic_in > clean_in))
    features = model.document_features([texts[i] for i in curve])
    is_toxic = label[curve] > 0.5
    shares = np.where(is_toxic, toxic_share, 1 - toxic_share)
    sizes = np.where(is_toxic, max(is_toxic.sum(), 1), max((~is_toxic).sum(), 1))
    model.platt = _platt(features, is_toxic.astype(float), shares / sizes * len(curve))
    return model


def train(docs: DataFrame, labels_table: DataFrame, column: str = "toxic", rows: int = TRAIN_ROWS_PER_CLASS) -> bytes:
    """The model fitted on at most ``rows`` labelled documents of each class; its size doesn't depend on the data."""
    known = labels_table.where(F.col(column).isNotNull() & ~held_out(F.col("doc_id")))
    share = known.agg(F.avg((F.col(column) >= 0.5).cast("double")).alias("share")).first()["share"]
    chosen = F.broadcast(labelled(labels_table, column, rows, per_class=True))  # at most 2 * ``rows`` ids

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sorted(
            row for b in batches for row in zip(b.column("doc_id").to_pylist(), utf8_rows(b.column("text")), b.column("label").to_pylist(), strict=True)
        )
        raw = b""
        if sample:
            raw = fit([t for _, t, _ in sample], np.array([float(y) for _, _, y in sample]), share).to_bytes()
        yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["model"])

    sample = keep(docs.select(F.col("doc_id"), "text").join(chosen, "doc_id"), "toxic-sample")
    found = sample.select(F.col("doc_id").cast("string"), "text", "label").repartition(1).mapInArrow(learn, "model binary")
    return b"".join(bytes(row["model"]) for row in found.collect())


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, from its text alone.

    - NULL and empty texts, and texts without a word of three letters, get the lowest score there is.
    - Without a model (no labels to learn from) every score is 0.
    - A NULL doc_id stays NULL and isn't held out; repeated rows are scored each; an empty table gives no rows.
    - Further columns are not read, whatever their names.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = KernelModel.of_bytes(model) if model else None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = utf8_rows(part.column("text"))
                found = fitted.of_texts(texts) if fitted else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted")
    )


def op8_insult_svm(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, labels(spark, sf_dir)))
