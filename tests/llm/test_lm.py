from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tickwarden.llm import lm

SCHEMA = "doc_id long, text string, score string, n_tokens int, row_id long"


def tokens(text):
    out = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        out = out.replace(c, " ")
    return [w for w in out.split(" ") if w] + ["\n"]


def data():
    rnd = random.Random(3)
    pairs = {"red": ["fox", "Car"], "blue": ["sky", "sea"], "fox": ["runs", "sleeps"], "sky": ["is", "red"], "sea": ["is", "blue"]}
    rows = []
    for i in range(300):
        w = ["red"]
        for _ in range(rnd.randrange(5, 60)):
            w.append(rnd.choice(pairs.get(w[-1].lower(), ["red", "blue"])) if rnd.random() < 0.9 else f"rare{rnd.randrange(400)}")
        rows.append((i, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, "\x0b \r"), (None, "red fox runs"), (1003, "ÉÀ é"), (1004, " ".join(rnd.choice(rows)[1] for _ in range(200))), (7, "red fox"), (7, "red fox")]
    return [(i, t, "x", 1, 2) for i, t in rows]


def test_base_is_exact_and_the_network_does_better(spark):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA)
    held = lm.held_out(F.col("doc_id"))
    got = lm.score(df, ~held).withColumn("held", lm.held_out(F.col("doc_id"))).collect()
    learn = [r for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 != 1]
    c = Counter(w for r in learn for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = []
    for r in rows:
        t = tokens(r[1])
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        want.append((r[0], len(t), sum(c[w] > 0 for w in t), n, round(base, 6)))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=key) == sorted(want, key=key)
    assert all(r["score"] < 0 for r in got)
    ours, base = (sum(r[k] for r in got if r["held"]) for k in ("score", "base_score"))
    assert ours > base


def test_counts_of_words_known_to_tasks_and_met_in_the_join_agree(spark, monkeypatch):
    df = spark.createDataFrame(data()[:60], SCHEMA)
    learn = F.col("doc_id") % 3 != 0
    whole = {r["doc_id"]: r for r in lm.score(df, learn).collect()}
    monkeypatch.setattr(lm, "KNOWN", 3)
    monkeypatch.setattr(lm, "FLUSH", 2)
    monkeypatch.setattr(lm, "train", lambda docs, key, text, v: lm.Network.start(v))
    for r in lm.score(df, learn).collect():
        for k in ("n_tokens", "n_known", "train_tokens"):
            assert r[k] == whole[r["doc_id"]][k]
        assert abs(r["base_score"] - whole[r["doc_id"]]["base_score"]) < 1e-6


def test_nothing_to_learn_from_and_no_rows(spark):
    df = spark.createDataFrame(data()[:5], SCHEMA)
    got = lm.score(df, F.lit(False)).collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in got} == {(0, 0, 0.0)}
    assert lm.score(df.limit(0), F.lit(True)).count() == 0


def small_vocabulary():
    counts = np.arange(50, 0, -1)
    ends = np.arange(50) % lm.ENDINGS
    tail = np.full(lm.ENDINGS, 4.0)
    return lm.Vocabulary({str(i).encode(): i for i in range(50)}, counts, ends, int(counts.sum() + tail.sum()), 60, tail, np.full(lm.ENDINGS, 2.0))


def test_gradients_match_differences():
    net = lm.Network(lm.Network.start(small_vocabulary()))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rnd = np.random.default_rng(1)
    docs = [rnd.integers(0, 50, size=n).astype(np.int32) for n in (5, 40, 17)]
    docs[1][3] = lm.CLASSES * lm.WORDS + 2
    x, y, keep, live, _ = next(lm.windows(docs, 2))
    h = rnd.normal(size=(x.shape[1], lm.STATE))

    def loss():
        s, _ = net.states(x, keep, h)
        return -net.output(s[live].astype(np.float64), y[live])[0].sum()

    _, grad = net.gradients(x, keep, h, y, live)
    for name, values in net.p.items():
        at = np.unravel_index(np.argmax(np.abs(grad[name])), values.shape)
        kept, step = values[at], 1e-2
        values[at] = kept + step
        up = loss()
        values[at] = kept - step
        down = loss()
        values[at] = kept
        assert abs((up - down) / (2 * step) - grad[name][at]) < 2e-2 * max(1.0, abs(grad[name][at]))


def test_output_is_a_distribution_and_windows_carry_the_state():
    v = small_vocabulary()
    net = lm.Network(lm.Network.start(v))
    s = np.random.default_rng(2).normal(size=(1, lm.STATE)).astype(np.float32)
    every = np.arange(lm.CLASSES * lm.WORDS + lm.ENDINGS)
    logs, _ = net.output(np.repeat(s, len(every), axis=0), every)
    assert abs(np.exp(logs).sum() - 1) < 1e-4
    rnd = np.random.default_rng(4)
    docs = [rnd.integers(0, 50, size=n).astype(np.int32) for n in (3, 200, 75, 1, 64)]
    together = lm.log_likelihoods(net, docs)
    for d, got in zip(docs, together):
        x = np.r_[lm.START, d[:-1]].astype(np.int32)[:, None]
        states, _ = net.states(x, (x != lm.START).astype(np.float32), np.zeros((1, lm.STATE), np.float32))
        assert abs(net.output(states[:, 0], d)[0].sum() - got) < 1e-3 * len(d)


def test_states_and_blocks_agree_with_the_plain_recurrence(monkeypatch):
    net = lm.Network(lm.Network.start(small_vocabulary()))
    rnd = np.random.default_rng(6)
    x, keep = rnd.integers(0, lm.INPUTS, size=(9, 5)), (rnd.random((9, 5)) > 0.2).astype(np.float32)
    h = first = rnd.normal(size=(5, lm.STATE)).astype(np.float32)
    trace = []
    got, last = net.states(x, keep, first, trace)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for t in range(9):
        h = h * keep[t][:, None]
        az, ar, an = np.split(net.p["e"][x[t]] @ net.p["w"] + net.p["b"], 3, axis=1)
        hz, hr, hn = np.split(h @ net.p["u"], 3, axis=1)
        z, r = sigmoid(az + hz), sigmoid(ar + hr)
        n = np.tanh(an + r * hn)
        for part, want in zip(trace, (h, hn, z, r, n)):
            assert np.abs(part[t] - want).max() < 1e-5
        h = z * h + (1 - z) * n
        assert np.abs(got[t] - h).max() < 1e-5
    assert np.abs(last - h).max() < 1e-5
    y = rnd.integers(0, lm.CLASSES * lm.WORDS + lm.ENDINGS, size=45)
    whole, parts = {}, {}
    logs, ds = net.output(got.reshape(-1, lm.STATE), y, whole)
    monkeypatch.setattr(lm, "BLOCK", 7)
    again, ds_again = net.output(got.reshape(-1, lm.STATE), y, parts)
    assert np.abs(logs - again).max() < 1e-4 and np.abs(ds - ds_again).max() < 1e-4
    assert all(np.abs(whole[k] - parts[k]).max() < 1e-4 for k in whole)


def test_windows_read_each_token_once():
    docs = [np.arange(n, dtype=np.int32) for n in (1, 33, 500, 32, 2, 90)]
    seen = [[] for _ in docs]
    for x, y, keep, live, who in lm.windows(docs, 3):
        for t in range(lm.WINDOW):
            for n in range(x.shape[1]):
                if live[t, n]:
                    assert x[t, n] == (lm.START if y[t, n] == 0 else y[t, n] - 1) and keep[t, n] == (y[t, n] != 0)
                    seen[who[t, n]].append(int(y[t, n]))
    assert [s == list(range(len(d))) for s, d in zip(seen, docs)] == [True] * len(docs)
