"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary text, over shared backoff counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwarden.llm.sampling import sample
from tickwarden.llm.words import fold

DOCUMENTS = 2000  # labelled texts a class
CHARACTERS = 3_000_000  # and their characters
LONGEST = 100_000  # of one labelled text
DISCOUNT = 0.75
SURE = 14.0  # likelihood ratio (G) at which classes differ so surely that an expression leaves the shared counts
MOST = 6.0  # what one word can say for or against, in nats
PARTS = 3  # parts of the sample, each measured by counts of the others, from which the curve is fitted
EDGES = ".,;:!?\"'()[]{}<>|#*$%&-_/\\"
UNKNOWN, START = 0, 1  # ids


def tokens(text: str | None) -> list[str]:
    """Lower-case words without marks at their edges; words of marks alone are left out."""
    return [] if not text else [w for w in (x.strip(EDGES) for x in text.lower().split()) if w]


class Counts:
    """In how many texts of one class each word and each pair (left word, word) stands. Words are numbers below `width`."""

    def __init__(self, texts: list[np.ndarray], width: int) -> None:
        none = [np.zeros(0, dtype=np.int64)]
        self.words = np.bincount(np.concatenate([*map(np.unique, texts), *none]), minlength=width)
        pairs = np.concatenate([*(np.unique(np.r_[0, t[:-1]] * width + t) for t in texts if len(t)), *none])
        self.pairs, self.times = np.unique(pairs, return_counts=True)
        self.left = np.bincount(self.pairs // width, weights=self.times, minlength=width)
        self.all = max(1, int(self.words.sum()))

    def times_of(self, pairs: np.ndarray) -> np.ndarray:
        if not len(self.pairs):
            return np.zeros(len(pairs))
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pairs, self.times[at], 0).astype(float)


def differ(a: np.ndarray, all_a: np.ndarray, b: np.ndarray, all_b: np.ndarray) -> np.ndarray:
    """Where counts a of all_a and b of all_b surely have different shares, by the likelihood ratio."""
    share = (a + b) / (all_a + all_b)
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(n > 0, n * np.log(n / (share * whole)), 0.0) for n, whole in ((a, all_a), (b, all_b))]
    return 2 * (parts[0] + parts[1]) > SURE


class Model:
    """ln(toxic / ordinary) of words and pairs as sorted arrays, and a logistic curve over the normalised sum.

    Pairs back off to words, words to the shared number of different pairs that they end. Where the classes do not surely
    differ in an expression, both take the shared count for it, so it says nothing; a rare one says only what its parts
    say.
    """

    def __init__(self, toxic: list[list[str]], ordinary: list[list[str]]) -> None:
        number: dict[str, int] = {"": 0}
        told = [[np.array([number.setdefault(w, len(number)) for w in text], dtype=np.int64) for text in texts] for texts in (toxic, ordinary)]
        width, names = len(number), list(number)
        t, o = (Counts(texts, width) for texts in told)
        pairs = np.union1d(t.pairs, o.pairs)
        ends = np.bincount(pairs % width, minlength=width)
        places, kinds = max(1, len(pairs)), int((ends > 0).sum())
        backoff = DISCOUNT * kinds / places
        shared = np.maximum(ends - DISCOUNT, 0) / places + backoff / (kinds + 1)
        sure = (ends > 0) & differ(t.words, t.all, o.words, o.all)
        low_t, low_o = (np.where(sure, np.maximum(c.words - DISCOUNT, 0) / c.all + backoff * shared, shared) for c in (t, o))
        a, b, h, w = t.times_of(pairs), o.times_of(pairs), pairs // width, pairs % width
        often = (a + b > SURE / 8) & (t.left[h] > 0) & (o.left[h] > 0)
        a, b, h, w = a[often], b[often], h[often], w[often]
        kept = differ(a, t.left[h], b, o.left[h])
        a, b, h, w = a[kept], b[kept], h[kept], w[kept]
        pair = np.log((np.maximum(a - DISCOUNT, 0) / t.left[h] + backoff * low_t[w]) / (np.maximum(b - DISCOUNT, 0) / o.left[h] + backoff * low_o[w]))

        used = np.unique(np.concatenate([np.flatnonzero(sure), h[h > 0], w])).tolist()
        self.ids = {names[i]: n + 2 for n, i in enumerate(used)}
        self.width = len(used) + 2
        self.word = np.zeros(self.width, dtype=np.float32)
        self.word[2:] = np.log(low_t[used] / low_o[used])
        place = np.zeros(width, dtype=np.int64)
        place[used] = np.arange(2, self.width)
        place[0] = START
        keys = place[h] * self.width + place[w]
        order = np.argsort(keys)
        self.pairs, self.pair = keys[order], pair[order].astype(np.float32)
        self.curve = np.zeros(3)

    def measure(self, texts: list[list[str]]) -> np.ndarray:
        """(difference of the log-likelihoods a word, asinh of the whole difference / 4) of each text; zero for no words."""
        sizes = np.array([len(t) for t in texts])
        out = np.zeros((len(texts), 2))
        if not sizes.sum():
            return out
        get = self.ids.get
        ids = np.fromiter((get(w, UNKNOWN) for t in texts for w in t), dtype=np.int64, count=int(sizes.sum()))
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        before[starts] = START
        says = self.word[ids]
        if len(self.pairs):
            keys = before * self.width + ids
            at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            says = np.where(self.pairs[at] == keys, self.pair[at], says)
        sums = np.add.reduceat(np.clip(says, -MOST, MOST).astype(np.float64), starts)
        out[sizes > 0, 0] = sums / sizes[sizes > 0]
        out[sizes > 0, 1] = np.arcsinh(sums / 4)
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray, share: float) -> None:
        """Fit the curve by Newton steps on measures of texts, weighed to the true share of toxic ones."""
        if not len(y) or y.min() == y.max():
            self.curve = np.array([np.log(share / (1 - share)), 0.0, 4.0])
            return
        x = np.c_[np.ones(len(y)), x * [10.0, 1.0]]
        weights = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        b = np.zeros(3)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            grad = x.T @ (weights * (y - p)) - 0.05 * b
            hess = (x * (weights * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
            step = np.clip(np.linalg.solve(hess, grad), -2, 2)
            b += step
            if np.abs(step).max() < 1e-8:
                break
        b[1:] = np.maximum(b[1:], 0.0)  # evidence for toxic text never lowers the score
        self.curve = b * [1.0, 10.0, 1.0]

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = self.curve[0] + self.measure([tokens(t) for t in texts]) @ self.curve[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, held: int = 0) -> Model:
    """A model from a bounded sample of labelled rows whose fold is not the held-out one.

    Of each class at most DOCUMENTS different texts with CHARACTERS characters are sampled. They make the counts; for the
    curve each part of them is measured by the counts of the others. The share of toxic texts comes from all labels outside the held-out fold. Without labelled rows
    of both kinds the models stay equal and the share alone decides.
    """
    known = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("label")).filter(F.col("label").isin(0, 1) & (fold(F.col("key"), folds) != held))
    counted = known.agg(F.avg("label").alias("share"), F.count("*").alias("n")).first()
    share = min(0.98, max(0.005, counted["share"] if counted["n"] else 0.005))
    got = sample(docs.select(docs[key].alias("key"), docs[text].alias("text")), known.distinct(), DOCUMENTS, CHARACTERS, LONGEST)
    texts = {y: [tokens(t) for label, _, t in got if label == y] for y in (0, 1)}
    if not texts[0] or not texts[1]:
        texts = {0: [], 1: []}
    measures, kinds = [np.zeros((0, 2))], []
    for k in range(PARTS):
        rest = Model(*[[t for i, t in enumerate(texts[y]) if i % PARTS != k] for y in (1, 0)])
        for y in (0, 1):
            part = texts[y][k::PARTS]
            measures.append(rest.measure(part))
            kinds += [y] * len(part)
    model = Model(texts[1], texts[0])
    model.calibrate(np.concatenate(measures), np.array(kinds, dtype=float), share)
    return model


def rate(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(row, score, predicted) for each row; `row` is the input row as a struct, predicted is 1 from a score of 0.5.

    score: chance of being toxic from how much likelier a word of the text is under the toxic than under the ordinary
    model, on average and in sum. Whole texts are scored. Null texts and texts without words get what the curve says of
    no evidence, well below 0.5 unless most texts are toxic. Repeated rows are kept. No rows give no rows.
    """
    at = docs.columns.index(text)
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.score(batch.column(at).slice(s, 64).to_pylist()) for s in range(0, batch.num_rows, 64)]
            row = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
            yield pa.RecordBatch.from_arrays([row, pa.array(np.concatenate(found) if found else [], pa.float64())], names=["row", "score"])

    return docs.mapInArrow(work, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
