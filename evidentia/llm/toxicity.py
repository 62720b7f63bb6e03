"""Toxicity: a support vector machine on a gapped-subsequence string kernel.

Kernel. A unit (a word with a boundary sign before and after it) is represented by all
its subsequences of ``ORDER`` characters whose gaps skip at most ``GAP`` characters each;
a subsequence that spans ``s`` characters weighs ``DECAY ** s``. Inserted characters
lengthen the span, so a disguised insult stays close to the plain one.

Nyström. Landmarks are units of the labelled sentences that best tell toxic from clean
training documents. ``K(landmarks, landmarks)**-1/2`` maps kernel values to features, and a
linear SVM is fitted on them by subgradient descent. Its decision is linear in the
kernel's feature space, so landmarks, map and weights fold into one weight per
subsequence. Scoring a unit is then a sum over its own subsequences, done for all
characters of a block of texts at once, and no landmark is visited per unit.

Labels belong to documents, not sentences: a toxic document must hold toxic units, a
clean one must not. A unit's training label is therefore its document's, and a document's
score is a logistic function, fitted on the same rows, of how many of its units are
above the margin and of their share.

Training reads at most ``TRAIN_ROWS`` labelled rows, those of the smallest hash, and at most
``TRAIN_BYTES`` of their texts; held-out
rows (crc32 of doc_id as text, modulo 3, is 1) are never among them. Inputs of a score are
characters of the text alone.

Null and empty texts have no unit and get the score of an empty document. Rows with null
ids are scored and count as not held out. Repeated rows each get a row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm import common

ORDER = 3
GAP = 2
DECAY = 0.7
LANDMARKS = 96
TRAIN_ROWS = 6000
#: Bytes of the texts it is fitted on at most.
TRAIN_BYTES = 64 << 20
#: Bytes of the texts it is fitted on at most.
TRAIN_BYTES = 64 << 20
THRESHOLD = 0.7

#: Characters are dealt to codes; 0 ends a unit and takes part in no subsequence.
CODES = 64
_EDGE = 1


def _codes() -> np.ndarray:
    """Code of each byte of lower-cased UTF-8 text: letters keep a code of their own."""
    code = np.zeros(256, dtype=np.int64)
    for b in range(256):
        if 97 <= b <= 122:
            code[b] = 2 + b - 97
        elif 65 <= b <= 90:
            code[b] = 2 + b - 65
        elif b >= 128:
            code[b] = 28 + b % 32
        elif 48 <= b <= 57:
            code[b] = 60
        elif b not in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D):
            code[b] = 61
    return code


_CODE = _codes()
#: Signs inside a word are skipped like inserted characters; white space ends a unit.
_SIGN = 61


class Units:
    """Words of neighbouring texts as codes in one row, each between two edge codes."""

    def __init__(self, texts: list[bytes]):
        words, self.rows = [], []
        for row, text in enumerate(texts):
            own = text.split()
            words += own
            self.rows += [row] * len(own)
        self.words = words
        # One blank on each side: it becomes the edge code.
        raw = np.frombuffer(b" " + b"  ".join(words) + b" ", dtype=np.uint8) if words else np.zeros(0, np.uint8)
        codes = _CODE[raw]
        codes[codes == 0] = _EDGE
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.codes = codes
        self.unit = np.repeat(np.arange(len(words)), lengths)


def subsequences(units: Units) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(unit, feature, weight) of all subsequences, one array per pair of gaps."""
    codes, unit = units.codes, units.unit
    n = len(codes)
    plain = codes != _SIGN
    for first in range(1, GAP + 2):
        for second in range(1, GAP + 2):
            span = first + second
            if n <= span:
                continue
            a, b, c = codes[: n - span], codes[first : n - second], codes[span:]
            ok = (unit[: n - span] == unit[span:]) & plain[: n - span] & plain[first : n - second] & plain[span:]
            at = np.flatnonzero(ok)
            yield unit[at], (a[at] * CODES + b[at]) * CODES + c[at], DECAY ** (span + 1)


def unit_sums(units: Units, weights: np.ndarray) -> np.ndarray:
    """Weighted sum of each unit's subsequences."""
    total = np.zeros(len(units.words))
    for unit, feature, weight in subsequences(units):
        total += np.bincount(unit, weights[feature], minlength=len(total)) * weight
    return total


def unit_norms(units: Units) -> np.ndarray:
    """Euclidean norm of each unit's representation, equal subsequences added up."""
    found = [(u, f, np.full(len(u), w)) for u, f, w in subsequences(units)]
    if not found:
        return np.zeros(len(units.words))
    unit, feature, weight = (np.concatenate(x) for x in zip(*found, strict=True))
    key, inverse = np.unique(unit * CODES**ORDER + feature, return_inverse=True)
    sums = np.bincount(inverse, weight)
    return np.sqrt(np.bincount(key // CODES**ORDER, sums**2, minlength=len(units.words)))


def vectors(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The features that occur in ``words``, and a unit-length row of them for each word."""
    units = Units([b" ".join(words)])
    rows = []
    for unit, feature, weight in subsequences(units):
        rows.append((unit, feature, np.full(len(unit), weight)))
    unit, feature, weight = (np.concatenate(x) for x in zip(*rows, strict=True))
    names, index = np.unique(feature, return_inverse=True)
    out = np.zeros((len(words), len(names)))
    np.add.at(out, (unit, index), weight)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return names, out / np.where(norms > 0, norms, 1)


@dataclass
class Model:
    weights: np.ndarray  # one per subsequence
    bias: float
    slope: tuple[float, ...]  # logistic, for ``design``

    def margins(self, words: list[bytes]) -> np.ndarray:
        units = Units([b" ".join(words)])
        norms = unit_norms(units)
        return unit_sums(units, self.weights) / np.where(norms > 0, norms, 1) + self.bias

    def above(self, words: list[bytes], least: float = 0.0) -> np.ndarray:
        """Whether each word's margin is over ``least``.

        Norms are computed where they can matter alone: squares of single weights bound them from below.
        """
        units = Units([b" ".join(words)])
        floor = np.zeros(len(words))
        for unit, _, weight in subsequences(units):
            floor += np.bincount(unit, minlength=len(words)) * weight**2
        near = unit_sums(units, self.weights) > (least - self.bias) * np.sqrt(floor)
        if least < self.bias:
            near[:] = True
        at = np.flatnonzero(near)
        out = np.zeros(len(words), dtype=bool)
        if len(at):
            out[at] = self.margins([words[i] for i in at.tolist()]) > least
        return out

    def design(self, n_units: int, n_above: int, n_kinds: int) -> tuple[float, ...]:
        share, kinds = (100 * n / (n_units + 20) for n in (n_above, n_kinds))
        return 1.0, min(n_above, 5) / 5, min(n_kinds, 4) / 4, min(share, 2.0), min(kinds, 1.5)

    def score(self, n_units: int, n_above: int, n_kinds: int) -> float:
        z = sum(a * b for a, b in zip(self.slope, self.design(n_units, n_above, n_kinds), strict=True))
        return float(1 / (1 + np.exp(-z)))


def _logistic(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(features.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        gradient = features.T @ (p - labels) + 0.1 * w
        hessian = (features * (p * (1 - p))[:, None]).T @ features + 0.1 * np.eye(len(w))
        w = w - np.linalg.solve(hessian, gradient)
    return w


def _svm(features: np.ndarray, labels: np.ndarray, costs: np.ndarray, steps: int = 1500) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge) by gradient descent; labels -1 and 1."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w = np.zeros(x.shape[1])
    costs = costs / costs.sum()
    velocity = np.zeros_like(w)
    for _ in range(steps):
        short = np.maximum(0, 1 - labels * (x @ w))
        gradient = 1e-4 * w - x.T @ (costs * labels * short)
        velocity = 0.9 * velocity - 0.3 * gradient
        w = w + velocity
    return w[:-1], float(w[-1])


def family(text: bytes) -> int:
    """Smallest hash of two neighbouring words: near copies nearly always share it."""
    words = text.split()
    return min((xxhash.xxh3_64_intdigest(a + b" " + b) for a, b in zip(words, words[1:])), default=0)


def _features(words: list[bytes], column: np.ndarray, width: int, mapping: np.ndarray) -> np.ndarray:
    """Nyström features of each word."""
    out = []
    for at in range(0, len(words), 500):
        units = Units([b" ".join(words[at : at + 500])])
        dense = np.zeros((len(units.words), width))
        for unit, feature, weight in subsequences(units):
            known = column[feature] >= 0
            np.add.at(dense, (unit[known], column[feature[known]]), weight)
        norms = unit_norms(units)[:, None]
        out.append(dense / np.where(norms > 0, norms, 1) @ mapping)
    return np.vstack(out)


def fit(rows: list[tuple[bytes, int]], landmarks: int = LANDMARKS, rounds: int = 4) -> Model:
    """A model from (text, label) rows. Without both labels it scores every text alike."""
    one = {(family(x.lower()), y): x.lower() for x, y in rows}
    texts = list(one.values())
    labels = np.array([y for _, y in one], dtype=float)
    n_toxic = int(labels.sum())
    n_clean = len(texts) - n_toxic
    rate = (n_toxic + 0.5) / (len(texts) + 1)
    flat = Model(np.zeros(CODES**ORDER), -1.0, (float(np.log(rate / (1 - rate))), 0.0, 0.0, 0.0, 0.0))
    if not n_toxic or not n_clean:
        return flat
    toxic, clean = Counter(), Counter()  # documents of each class that hold a word
    for text, label in zip(texts, labels, strict=True):
        (toxic if label else clean).update(set(text.split()))

    def excess(word: bytes) -> float:
        """Standard deviations by which toxic documents hold the word more often than their share."""
        n = toxic[word] + clean[word]
        return (toxic[word] - n * rate) / np.sqrt(n * rate * (1 - rate))

    positive = sorted((w for w, n in toxic.items() if n >= 3 and excess(w) > 5), key=lambda w: (-excess(w), w))
    if not positive:
        positive = sorted(toxic, key=lambda w: (-excess(w), w))[:10]
    best = [w for w in positive if len(w) <= 40][:landmarks]
    if not best:
        return flat
    names, landmark = vectors(best)
    values, basis = np.linalg.eigh(landmark @ landmark.T)
    keep = values > 1e-6 * values.max()
    mapping = landmark.T @ (basis[:, keep] / np.sqrt(values[keep]))
    column = np.full(CODES**ORDER, -1)
    column[names] = np.arange(len(names))
    ordinary = sorted((w for w in clean if excess(w) < 2), key=lambda w: (-clean[w], w))
    stride = max(1, len(ordinary) // 4000)
    negative = dict.fromkeys(ordinary[:2000] + ordinary[2000::stride])
    everything = sorted(clean)
    x_positive = _features(positive, column, len(names), mapping)
    cost_positive = np.array([toxic[w] for w in positive], dtype=float)
    model = flat
    for turn in range(rounds):
        words = list(negative)
        x = np.vstack([x_positive, _features(words, column, len(names), mapping)])
        y = np.r_[np.ones(len(positive)), -np.ones(len(words))]
        cost_negative = np.array([1.0 + clean[w] for w in words])
        costs = np.r_[cost_positive / cost_positive.sum(), cost_negative / cost_negative.sum()]
        w, bias = _svm(x, y, costs)
        weights = np.zeros(CODES**ORDER)
        weights[names] = mapping @ w
        model = Model(weights, bias, flat.slope)
        if turn + 1 < rounds:  # clean words that look toxic are the next round's examples
            for start, end in common.chunks([len(w) for w in everything], common.CHUNK // 8):
                part = everything[start:end]
                near = np.flatnonzero(model.above(part, -0.3))
                negative.update(dict.fromkeys(part[i] for i in near.tolist() if part[i] not in toxic or excess(part[i]) < 3))
    scorer = Scorer(model)
    design = np.array([model.design(*scorer.count(t)) for t in texts])
    model.slope = tuple(_logistic(design, labels).tolist())
    return model


class Scorer:
    """Scores texts; remembers the margins of words it has met."""

    KEPT = 400_000

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[bytes, bool] = {}

    def learn(self, texts: list[bytes]) -> None:
        new = set().union(*(t.split() for t in texts)).difference(self.known)
        if len(self.known) + len(new) > self.KEPT:
            self.known = {}
            new = set().union(*(t.split() for t in texts))
        words = sorted(new)
        for start, end in common.chunks([len(w) for w in words], common.CHUNK // 8):
            part = words[start:end]
            self.known.update(zip(part, self.model.above(part).tolist(), strict=True))

    def count(self, text: bytes) -> tuple[int, int, int]:
        """Units of a lower-cased text, those above the margin, and how many of these differ."""
        words = text.split()
        try:
            above = [w for w in words if self.known[w]]
        except KeyError:
            self.learn([text])
            above = [w for w in words if self.known[w]]
        return len(words), len(above), len(set(above))


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column("__toxic_text").to_pylist()
            scores = []
            for start, end in common.chunks([len(t or b"") for t in texts], 4 * common.CHUNK):
                plain = [(t or b"").lower() for t in texts[start:end]]
                scorer.learn(plain)
                scores += [model.score(*scorer.count(t)) for t in plain]
            names = [n for n in batch.schema.names if n != "__toxic_text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(scores, pa.float64())], [*names, "score"]
            )

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _fitted(max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic"), strict=True):
                text = text.as_py()
                if held + len(text) <= max_bytes:
                    rows.append((text, toxic.as_py()))
                    held += len(text)
        model = fit(sorted(rows))
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias], pa.float64()),
             pa.array([list(map(float, model.slope))], pa.list_(pa.float64()))],
            ["weights", "bias", "slope"],
        )

    return run


def _fitted(max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                if held + len(text) <= max_bytes:
                    rows.append((text, toxic))
                    held += len(text)
        model = fit(sorted(rows))
        columns = [
            pa.array([model.weights.tobytes()], pa.binary()),
            pa.array([float(model.bias)], pa.float64()),
            pa.array([[float(x) for x in model.slope]], pa.list_(pa.float64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["weights", "bias", "slope"])

    return run


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on at most ``rows`` labelled ids that are not held out, those of the smallest id hash.

    Of their texts, taken in that order, those are used that fit into ``max_bytes`` together. An
    id with several labels counts as toxic if one of them is. One task fits; the driver gets
    the model alone.
    """
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    each = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("binary").alias("text"))
    sample = texts.join(chosen, "doc_id").distinct().repartition(1)
    ordered = sample.sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text").select("text", "toxic")
    found = ordered.mapInArrow(_fitted(max_bytes), "weights binary, bias double, slope array<double>").collect()
    if not found:
        return fit([])
    return Model(np.frombuffer(found[0]["weights"]), found[0]["bias"], tuple(found[0]["slope"]))


def scores(rows: DataFrame, model: Model) -> DataFrame:
    """Columns of ``rows`` (a ``text`` among them, which is dropped) and ``score``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["score double"])
    source = rows.withColumn("__toxic_text", F.col("text").cast("binary")).drop("text")
    return source.mapInArrow(_scorer(shared), schema)


def reject(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` with all their columns, without rows that score ``threshold`` or more."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    scorers: list[Scorer] = []  # one for each task, made where it runs

    def score(texts: pd.Series) -> pd.Series:
        if not scorers:
            scorers.append(Scorer(shared.value))
        plain = [bytes(t).lower() for t in texts]
        out: list[float] = []
        for start, end in common.chunks([len(t) for t in plain], 4 * common.CHUNK):
            scorers[0].learn(plain[start:end])
            out += [shared.value.score(*scorers[0].count(t)) for t in plain[start:end]]
        return pd.Series(out, dtype="float64")

    score.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    value = F.pandas_udf(score, "double")(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    return documents.withColumn("__score", value).where(F.col("__score") < threshold).drop("__score")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    model = train(documents, common.table(spark, sf_dir, "labels"))
    found = scores(documents.select("doc_id", "text"), model)
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
