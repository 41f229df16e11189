"""Document likelihoods by a gated recurrent language model with a class-factored output, next to a unigram base."""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwarden.llm.words import END, fold, lower_words
from tickwarden.session import cut

WORDS = 64  # words of a class that the network tells apart
CLASSES = 32  # such classes: the most frequent words, in order of frequency
ENDINGS = 32  # classes of all other words, by their last three bytes; inside, shares of counts
KNOWN = 1 << 17  # at most so many of the most frequent words have counts that every task holds; others meet theirs in a join
STATE = 16  # units of the network, and numbers of an input vector
WINDOW = 32  # steps through which training goes back
TRAIN_LANES, SCORE_LANES = 256, 512  # documents read side by side
BLOCK = 1024  # tokens whose classes are formed at a time
BUFFER = 1 << 22  # tokens that are arranged in lanes at a time
ROUNDS = (1, 7)  # eighths of the training documents after which the tasks' networks are averaged
RATE = 0.005
FLUSH = 400_000  # different words that a task counts before it passes them on
START = CLASSES * WORDS + ENDINGS  # input that stands before a document
INPUTS = START + 1


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(token, ending, c) over all given documents; each also counts one END. Tasks pre-count before the shuffle."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = list(seen)
            out = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array([ending(w) for w in words], pa.int32()), pa.array(list(seen.values()), pa.int64())],
                names=["token", "ending", "c"])
            seen.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for t in batch.column(0).slice(at, 64).to_pylist():
                    seen.update(lower_words(t))
                    seen[END] += 1
                if len(seen) > FLUSH:
                    yield flush()
        if seen:
            yield flush()

    parts = docs.select(docs[text].alias("text")).mapInArrow(work, "token binary, ending int, c long")
    return parts.groupBy("token", "ending").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Vocabulary:
    """The KNOWN most frequent words with their counts, and per ending the tokens and words outside the network's own."""

    words: dict[bytes, int]
    counts: np.ndarray
    endings: np.ndarray  # of the known words
    total: int  # training tokens
    size: int  # different ones
    tail_tokens: np.ndarray
    tail_words: np.ndarray

    @property
    def own(self) -> int:
        return min(len(self.counts), CLASSES * WORDS)

    def inputs(self) -> np.ndarray:
        """Input number of each known word: its place among the network's own words, else its ending."""
        places = np.arange(len(self.counts))
        return np.where(places < self.own, places, CLASSES * WORDS + self.endings).astype(np.int32)

    def share_in_ending(self) -> np.ndarray:
        """ln share of each known word within its ending's class."""
        return np.log((self.counts + 0.5) / (self.tail_tokens + 0.5 * (self.tail_words + 1))[self.endings])


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Words are known down to the least count level, of steps under five percent, at which there are at most KNOWN."""
    level = F.floor(F.log2("c") * 16)
    at, known, least = [], 0, None
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        if known + r["n"] > KNOWN:
            break
        known, least = known + r["n"], r["level"]
    if least is not None:
        at = counts.filter(level >= least).collect()
    rows = sorted(at, key=lambda r: (-r["c"], bytes(r["token"])))
    words = {bytes(r["token"]): i for i, r in enumerate(rows)}
    c = np.array([r["c"] for r in rows], dtype=np.int64)
    ends = np.array([r["ending"] for r in rows], dtype=np.int64)
    tokens, sizes = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in counts.groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        tokens[r["ending"]], sizes[r["ending"]] = r["c"], r["n"]
    total, size = int(tokens.sum()), int(sizes.sum())
    own = min(len(c), CLASSES * WORDS)
    np.subtract.at(tokens, ends[:own], c[:own])
    np.subtract.at(sizes, ends[:own], 1)
    return Vocabulary(words, c, ends, total, size, tokens, sizes)


class Network:
    """A GRU; its state gives a class by one softmax and a word of the class by another."""

    def __init__(self, params: dict[str, np.ndarray]) -> None:
        self.p = {k: v.astype(np.float32) for k, v in params.items()}

    @staticmethod
    def start(v: Vocabulary, seed: int = 11) -> dict[str, np.ndarray]:
        """Small random weights; biases that already give the unigram shares."""
        rnd = np.random.default_rng(seed)
        own = np.full(CLASSES * WORDS, 1e-4)
        own[:v.own] = v.counts[:v.own]
        own = own.reshape(CLASSES, WORDS)
        mass = np.concatenate([own.sum(axis=1), v.tail_tokens + 0.5])
        return {
            "e": rnd.normal(0, 0.3, (INPUTS, STATE)), "w": rnd.normal(0, 0.3, (STATE, 3 * STATE)), "u": rnd.normal(0, 0.3, (STATE, 3 * STATE)),
            "b": np.concatenate([np.ones(STATE), np.zeros(2 * STATE)]),
            "wc": rnd.normal(0, 0.05, (STATE, CLASSES + ENDINGS)), "bc": np.log(mass / mass.sum()),
            "wk": rnd.normal(0, 0.05, (CLASSES, STATE, WORDS)), "bk": np.log(own / own.sum(axis=1, keepdims=True)),
        }

    def states(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray, trace: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States after each of the inputs x (step, lane); keep is 0 where a document begins. Also the last state.

        `trace` gets arrays (step, lane, unit): the state before, what it gives to n, and the gates z, r and n.
        """
        steps, lanes = x.shape
        # An input's part of the gates is the same wherever it stands.
        parts = by_gate(self.p["e"] @ self.p["w"] + self.p["b"])
        a = np.empty((3, steps, lanes, STATE), dtype=parts.dtype)
        for part, rows in zip(parts, a):
            part.take(x, axis=0, out=rows, mode="clip")
        u, out = by_gate(self.p["u"]), np.empty((steps, lanes, STATE), dtype=a.dtype)
        before, given = (np.empty_like(out), np.empty_like(out)) if trace is not None else (None, None)
        hu, whole = np.empty((3, lanes, STATE), dtype=a.dtype), keep.all(axis=1)
        for t in range(steps):
            if not whole[t]:
                h = h * keep[t][:, None]
            np.matmul(h, u, out=hu)
            zr, n = a[:2, t], a[2, t]
            zr += hu[:2]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            if trace is not None:
                before[t], given[t] = h, hu[2]
            hu[2] *= zr[1]
            n += hu[2]
            np.tanh(n, out=n)
            after = out[t]
            np.subtract(h, n, out=after)
            after *= zr[0]
            after += n
            h = after
        if trace is not None:
            trace += [before, given, *a]
        return out, h

    def output(self, s: np.ndarray, y: np.ndarray, grad: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """ln P(class of y) + ln P(y in its class) for states s; y counts the network's words, then endings.

        With grad, also adds the gradients of the summed loss and returns the one of the states.
        """
        kind = np.where(y < CLASSES * WORDS, y // WORDS, y - CLASSES * WORDS + CLASSES)
        rows = np.arange(len(y))
        out, ds, near = np.empty(len(y), dtype=s.dtype), None, small(self.p["wc"], self.p["bc"])
        if grad is not None:
            ds, grad["wc"], grad["bc"] = np.empty_like(s), np.zeros_like(self.p["wc"]), np.zeros_like(self.p["bc"])
        # A block's numbers stay in the processor's cache from one step to the next.
        for lo in range(0, len(y), BLOCK):
            mine, at = s[lo:lo + BLOCK], (rows[:len(y) - lo][:BLOCK], kind[lo:lo + BLOCK])
            logits = mine @ self.p["wc"]
            logits += self.p["bc"]
            if not near:
                logits -= logits.max(axis=1, keepdims=True)
            chosen = logits[at]
            np.exp(logits, out=logits)
            sums = logits @ np.ones(CLASSES + ENDINGS, dtype=np.float32)
            out[lo:lo + BLOCK] = chosen - np.log(sums)
            if grad is not None:
                logits /= sums[:, None]
                logits[at] -= 1
                grad["wc"] += mine.T @ logits
                grad["bc"] += np.ones(len(mine), dtype=np.float32) @ logits
                np.matmul(logits, self.p["wc"].T, out=ds[lo:lo + BLOCK])
        if grad is not None:
            grad["wk"], grad["bk"] = np.zeros_like(self.p["wk"]), np.zeros_like(self.p["bk"])
        # Small whole numbers are sorted by their digits.
        order = np.argsort(kind.astype(np.uint8), kind="stable")
        edges = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        order = order[:edges[CLASSES]]
        mine, place, inside = s[order], y[order] % WORDS, np.empty(len(order), dtype=out.dtype)
        back, ones, near = None if grad is None else np.empty_like(mine), np.ones(max(len(order), WORDS), dtype=np.float32), small(self.p["wk"], self.p["bk"])
        for k in range(CLASSES):
            lo, hi = edges[k], edges[k + 1]
            if lo == hi:
                continue
            at = rows[:hi - lo], place[lo:hi]
            q = mine[lo:hi] @ self.p["wk"][k]
            q += self.p["bk"][k]
            if not near:
                q -= q.max(axis=1, keepdims=True)
            picked = q[at]
            np.exp(q, out=q)
            total = q @ ones[:WORDS]
            inside[lo:hi] = picked - np.log(total)
            if grad is not None:
                q /= total[:, None]
                q[at] -= 1
                grad["wk"][k], grad["bk"][k] = mine[lo:hi].T @ q, ones[:hi - lo] @ q
                np.matmul(q, self.p["wk"][k].T, out=back[lo:hi])
        out[order] += inside
        if grad is not None:
            ds[order] += back
        return out, ds

    def gradients(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray, y: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """The last state and the gradients of one window's summed loss, through all of its steps and no further."""
        steps, lanes = x.shape
        trace: list[np.ndarray] = []
        s, last = self.states(x, keep, h, trace)
        grad: dict[str, np.ndarray] = {}
        _, ds_live = self.output(s[live], y[live], grad)
        ds = np.zeros_like(s)
        ds[live] = ds_live
        before, hn, z, r, n = trace
        by_n = (1 - z) * (1 - n * n)
        # What reaches the state's part of each gate; n's own part differs by r.
        dhu, dn = np.stack([(before - n) * z * (1 - z), hn * r * (1 - r), r]), np.empty_like(s)
        dh, back = np.zeros((lanes, STATE), dtype=s.dtype), np.empty((3, lanes, STATE), dtype=s.dtype)
        ut, whole = by_gate(self.p["u"]).swapaxes(1, 2), keep.all(axis=1)
        for t in range(steps - 1, -1, -1):
            dh += ds[t]
            part = dhu[:, t]
            np.multiply(dh, by_n[t], out=dn[t])
            part[0] *= dh
            part[1:] *= dn[t]
            np.matmul(part, ut, out=back)
            dh *= z[t]
            dh += back[0]
            dh += back[1]
            dh += back[2]
            if not whole[t]:
                dh *= keep[t][:, None]
        beside = lambda gates: np.concatenate(gates, axis=1)
        rows = dhu.reshape(3, -1, STATE)
        grad["u"] = beside(before.reshape(-1, STATE).T @ rows)
        flat = beside([rows[0], rows[1], dn.reshape(-1, STATE)])
        ids = x.ravel()
        grad["w"], grad["b"] = self.p["e"][ids].T @ flat, flat.sum(axis=0)
        de = flat @ self.p["w"].T
        order = np.argsort(ids.astype(np.uint16), kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(ids[order]) > 0])
        grad["e"] = np.zeros_like(self.p["e"])
        grad["e"][ids[order][first]] = np.add.reduceat(de[order], first)
        return last, grad


def by_gate(weights: np.ndarray) -> np.ndarray:
    """Rows of the gates z, r and n side by side as one array per gate, in which the numbers of all lanes stand together."""
    return np.ascontiguousarray(weights.reshape(-1, 3, STATE).swapaxes(0, 1))


def small(weights: np.ndarray, biases: np.ndarray) -> bool:
    """Whether no state, whose units lie between -1 and 1, gives a number whose exponential float32 cannot hold."""
    return float((np.abs(weights).sum(axis=-2) + np.abs(biases)).max()) < 60.0


def flat(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in sorted(params)]).astype(np.float32)


def unflat(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at:at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def windows(documents: list[np.ndarray], lanes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(inputs, targets, keep, live, document) of shape (step, lane), window by window; a state runs on between them.

    Each document is read by one lane from its first to its last token. Lanes are filled evenly, the longest documents
    first, and stand in order of length; later windows hold only the lanes that still have text.
    """
    if not documents:
        return
    order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    heap = [(0, n) for n in range(min(lanes, len(documents)))]
    given: list[list[int]] = [[] for _ in heap]
    for i in order:
        used, n = heapq.heappop(heap)
        given[n].append(i)
        heapq.heappush(heap, (used + len(documents[i]), n))
    sizes = [sum(len(documents[i]) for i in g) for g in given]
    by = sorted(range(len(given)), key=lambda n: -sizes[n])
    targets = [np.concatenate([documents[i] for i in given[n]]) for n in by]
    inputs = [np.concatenate([np.r_[np.int32(START), documents[i][:-1]] for i in given[n]]) for n in by]
    owners = [np.repeat(np.array(given[n], dtype=np.int32), [len(documents[i]) for i in given[n]]) for n in by]
    lengths = np.array([len(t) for t in targets])
    for at in range(0, int(lengths[0]), WINDOW):
        active = int(np.searchsorted(-lengths, -at, side="left"))
        shape = (WINDOW, active)
        x, y, who = np.full(shape, START, np.int32), np.zeros(shape, np.int32), np.zeros(shape, np.int32)
        live = np.zeros(shape, dtype=bool)
        for n in range(active):
            size = min(WINDOW, int(lengths[n]) - at)
            x[:size, n], y[:size, n], who[:size, n] = inputs[n][at:at + size], targets[n][at:at + size], owners[n][at:at + size]
            live[:size, n] = True
        yield x, y, (x != START).astype(np.float32), live, who


class Trainer:
    """Adam over windows. What counts in the end is the running mean of the parameters, which evens out single windows."""

    def __init__(self, net: Network) -> None:
        self.net, self.t, self.tokens = net, 0, 0
        self.first = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.second = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.mean = {k: v.copy() for k, v in net.p.items()}

    def read(self, documents: list[np.ndarray]) -> None:
        """One pass over the documents by truncated backpropagation.

        Lanes are as many as the longest document lets be filled; a window that holds fewer tokens moves the network less.
        """
        if not documents:
            return
        total = sum(map(len, documents))
        lanes = max(8, min(TRAIN_LANES, total // max(map(len, documents))))
        self.tokens += total
        h = None
        for x, y, keep, live, _ in windows(documents, lanes):
            h = np.zeros((x.shape[1], STATE), dtype=np.float32) if h is None else h[:x.shape[1]]
            h, grad = self.net.gradients(x, keep, h, y, live)
            self.t += 1
            rate = RATE * min(1.0, self.t / 40) / (1 - 0.9**self.t)
            for k, g in grad.items():
                g /= lanes * WINDOW
                m, s, p = self.first[k], self.second[k], self.net.p[k]
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * m / (np.sqrt(s / (1 - 0.999**self.t)) + 1e-8)
                if self.t % 4 == 0:
                    self.mean[k] += max(0.04, 4 / (self.t + 4)) * (p - self.mean[k])


def log_likelihoods(net: Network, documents: list[np.ndarray]) -> np.ndarray:
    """ln P by the network of each document: of its tokens, or of their ending's class for words it has not."""
    out = np.zeros(len(documents))
    h = None
    for x, y, keep, live, who in windows(documents, SCORE_LANES):
        h = np.zeros((x.shape[1], STATE), dtype=np.float32) if h is None else h[:x.shape[1]]
        s, h = net.states(x, keep, h)
        got, _ = net.output(s[live], y[live])
        out += np.bincount(who[live], weights=got, minlength=len(documents))
    return out


class Reader:
    """Turns texts into input numbers and sums what the known counts give."""

    def __init__(self, v: Vocabulary) -> None:
        self.get, self.numbers = v.words.get, v.inputs()
        self.base = np.log10(v.counts + 0.5)
        self.tail = np.where(np.arange(len(v.counts)) < v.own, 0.0, v.share_in_ending()) if len(v.counts) else np.zeros(0)

    def numbers_of(self, text: str | None) -> np.ndarray:
        """Input numbers of the text's tokens."""
        words = lower_words(text)
        words.append(END)
        at = np.fromiter(map(self.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        rest = np.flatnonzero(at < 0).tolist()
        out = self.numbers[at] if len(self.numbers) else np.empty(len(words), dtype=np.int32)
        out[rest] = [CLASSES * WORDS + ending(words[i]) for i in rest]
        return out

    def read(self, text: str | None) -> tuple[np.ndarray, int, float, float, Counter]:
        """(numbers, known tokens, sum of log10(c + 0.5), sum of ln shares in endings) and the words left to the join."""
        words = lower_words(text)
        words.append(END)
        get = self.get
        at = np.fromiter(map(get, words, repeat(-1)), dtype=np.int64, count=len(words))
        known = at >= 0
        numbers = np.empty(len(words), dtype=np.int32)
        numbers[known] = self.numbers[at[known]]
        rest = np.flatnonzero(~known).tolist()
        other = [words[i] for i in rest]
        numbers[rest] = [CLASSES * WORDS + ending(w) for w in other]
        return numbers, len(words) - len(other), float(self.base[at[known]].sum()), float(self.tail[at[known]].sum()), Counter(other)


def train(docs: DataFrame, key: str, text: str, v: Vocabulary) -> dict[str, np.ndarray]:
    """Parameters after one pass over all given documents.

    Each task trains on its own partition from the same start; the average, weighed by tokens, is where all tasks go on.
    It is formed by an aggregation over parameter positions; only the model itself, of fixed size, reaches the driver.
    """
    spark = docs.sparkSession
    params = Network.start(v)
    if not v.total:
        return params
    rows = docs.select(docs[text].alias("text"), F.pmod(F.xxhash64(F.lit(3), docs[key].cast("string")), F.lit(8)).alias("eighth"))
    sent_words = spark.sparkContext.broadcast(v)
    done = 0
    for eighths in ROUNDS:
        sent = spark.sparkContext.broadcast(params)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader, trainer, waiting, size = Reader(sent_words.value), Trainer(Network(sent.value)), [], 0
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    for t in batch.column(0).slice(at, 64).to_pylist():
                        waiting.append(reader.numbers_of(t))
                        size += len(waiting[-1])
                        if size >= BUFFER:
                            trainer.read(waiting)
                            waiting, size = [], 0
            trainer.read(waiting)
            if trainer.tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([float(trainer.tokens)]), pa.array([flat(trainer.mean)], pa.list_(pa.float32()))], names=["weight", "params"])

        part = rows.filter((F.col("eighth") >= done) & (F.col("eighth") < done + eighths)).select("text")
        trained = part.mapInArrow(work, "weight double, params array<float>").select("weight", F.posexplode("params").alias("place", "value"))
        mean = (F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("value")
        got = trained.groupBy("place").agg(mean).toArrow()
        done += eighths
        if got.num_rows:
            values = np.zeros(got.num_rows, dtype=np.float32)
            values[got["place"].to_numpy()] = got["value"].to_numpy()
            params = unflat(values, params)
    return params


def score(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) for every row; `learn` says which rows are learned from.

    Tokens are words with A-Z lower-cased and one END a document. base_score: sum of log10 of additively smoothed
    unigram shares. score: log10 probability of the document under the network, whose state starts afresh with each
    document and runs through all of it. Words outside the network's vocabulary have the probability of their ending's
    class times their smoothed share of it; their counts come by a join, in which no word is hot, because the frequent
    ones are known to every task.

    Null texts and texts without words are END alone. Null keys and repeated rows are kept. Without rows to learn from,
    every token is unknown. No rows give no rows.
    """
    spark = docs.sparkSession
    counts = cut(count_words(docs.filter(learn), text))
    v = vocabulary(counts)
    params = train(docs.filter(learn), key, text, v)
    sent_words, sent = spark.sparkContext.broadcast(v), spark.sparkContext.broadcast(params)
    schema = T.StructType([
        T.StructField("key", docs.schema[key].dataType), T.StructField("row_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("ln_p", T.DoubleType()),
        T.StructField("tokens", T.ArrayType(T.BinaryType())), T.StructField("times", T.ArrayType(T.LongType())),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, net = Reader(sent_words.value), Network(sent.value)
        part, made = TaskContext.get().partitionId() << 33, 0
        keys, read, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal made, size
            ln_p = log_likelihoods(net, [r[0] for r in read]) + np.array([r[3] for r in read])
            out = pa.RecordBatch.from_arrays([
                pa.array(keys, type=key_type), pa.array(part + made + np.arange(len(read)), pa.int64()),
                pa.array([len(r[0]) for r in read], pa.int64()), pa.array([r[1] for r in read], pa.int64()), pa.array([r[2] for r in read]),
                pa.array(ln_p), pa.array([list(r[4]) for r in read], pa.list_(pa.binary())),
                pa.array([list(r[4].values()) for r in read], pa.list_(pa.int64()))], names=schema.names)
            made += len(read)
            keys.clear()
            read.clear()
            size = 0
            return out

        for batch in batches:
            key_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 64):
                for k, t in zip(batch.column(0).slice(at, 64).to_pylist(), batch.column(1).slice(at, 64).to_pylist()):
                    keys.append(k)
                    read.append(reader.read(t))
                    size += len(read[-1][0])
                    if size >= BUFFER:
                        yield flush()
        if read:
            yield flush()

    scored = cut(docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(work, schema))
    pairs = F.explode(F.arrays_zip("tokens", "times")).alias("p")
    rest = scored.filter(F.size("tokens") > 0).select("row_id", pairs).select("row_id", F.col("p.tokens").alias("token"), F.col("p.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    ends = F.pmod(F.crc32(F.expr("substring(token, greatest(octet_length(token) - 2, 1), 3)")), F.lit(ENDINGS)).cast("int")
    per_ending = F.array(*[F.lit(float(n + 0.5 * (w + 1))) for n, w in zip(v.tail_tokens, v.tail_words)])
    met = rest.join(counts.select("token", "c"), "token", "left").select(
        "row_id", F.when(c > 0, F.col("times")).otherwise(0).alias("known"), (F.col("times") * F.log10(c + 0.5)).alias("base"),
        (F.col("times") * F.log((c + 0.5) / F.get(per_ending, ends))).alias("ln_p"))
    sums = met.groupBy("row_id").agg(F.sum("known").alias("k"), F.sum("base").alias("b"), F.sum("ln_p").alias("l"))
    zero = lambda name: F.coalesce(name, F.lit(0))
    per_token = math.log10(v.total + 0.5 * (v.size + 1))
    return scored.drop("tokens", "times").join(sums, "row_id", "left").select(
        F.col("key").alias(key), "n_tokens", (F.col("n_known") + zero("k")).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b") - F.col("n_tokens") * per_token).alias("base_score"),
        ((F.col("ln_p") + zero("l")) / math.log(10)).alias("score"))


def held_out(key: Column) -> Column:
    return fold(key, 5) == 1
