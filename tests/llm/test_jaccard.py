from __future__ import annotations

import random

import numpy as np
import pytest

from tickwarden.llm import jaccard, linking
from tickwarden.llm.words import lower_words

SCHEMA = "doc_id long, text string, key string, set_id int, size int, bits string"


def shingles(text, width=3):
    w = lower_words(text)
    return set(zip(*[w[i:] for i in range(width)])) if len(w) >= width else {tuple(w)} if w else set()


def plain(rows, width=3, num=9, den=10):
    """Components by comparing everything with everything."""
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted((str(k), len(sets[i]), str(least.get(find(i)))) for i, (k, _) in enumerate(rows))


def run(spark, rows, width=3, similarity=(9, 10)):
    df = spark.createDataFrame([(k, t, "x", 1, 2, "y") for k, t in rows], SCHEMA).repartition(5)
    got = jaccard.join(df, width=width, similarity=similarity)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got.collect())


def families(rnd, count, copies, sizes=(12, 15, 25, 60, 200, 700)):
    """Texts with edited, appended, prepended and cut copies on both sides of the threshold, over one shared passage."""
    word = lambda: "w%d" % rnd.randrange(5000)
    passage, out = [word() for _ in range(80)], []
    for _ in range(count):
        n = rnd.choice(sizes)
        base = [word() for _ in range(n)]
        if rnd.random() < 0.4:
            base[n // 2:n // 2] = passage[:rnd.randrange(20, 80)]
        for _ in range(copies):
            t = list(base)
            spent = max(1, int(len(t) * rnd.choice([0.01, 0.02, 0.03, 0.06, 0.1, 0.12])))
            kind = rnd.randrange(4)
            if kind == 0:
                for _ in range(max(1, spent // 3)):
                    t[rnd.randrange(len(t))] = word()
            elif kind == 1:
                t += [word() for _ in range(spent)]
            elif kind == 2:
                t = [word() for _ in range(spent)] + t
            else:
                t = t[:len(t) - spent]
            out.append(" ".join(t))
    return out


@pytest.mark.parametrize("width,similarity", [(3, (9, 10)), (5, (4, 5))])
def test_components_equal_brute_force(spark, width, similarity):
    rnd = random.Random(width)
    texts = families(rnd, 60, 6) + families(rnd, 2, 60)
    rows = list(enumerate(texts)) + [(5000 + i, texts[0].upper()) for i in range(40)]
    rnd.shuffle(rows)
    assert run(spark, rows, width, similarity) == plain(rows, width, *similarity)


def test_blocks_and_late_turns_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(linking, "BLOCK", 7)
    monkeypatch.setattr(linking, "TURNS", 1)
    rows = list(enumerate(families(random.Random(9), 3, 70, sizes=(40, 120))))
    assert run(spark, rows) == plain(rows)


def test_short_null_repeated_long_and_no_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one"), (5, "ONE"), (6, "a b"), (6, "a b"), (7, "a b c"), (None, "a b c"), (None, "alone here now"), (8, "x " * 30000),
            (9, "X " * 40000), (10, " ".join("w%d" % i for i in range(30000))), (11, " ".join("w%d" % i for i in range(30100)))]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == [] and run(spark, [(1, None)]) == [("1", 0, "1")]


def test_similar_sets_share_a_key_and_bitmaps_never_overstate():
    rnd, levels = np.random.default_rng(5), jaccard.Levels((9, 10))
    for n in [*range(9, 40), 100, 333, 2000]:
        for _ in range(40):
            x = rnd.integers(0, 2**36, n, dtype="<u8")
            spare = [(a, b) for a in range(n) for b in range(n) if 10 * (n - a) >= 9 * (n + b)][-1] if n < 200 else (n // 20, n // 20 - 1)
            y = np.concatenate([x[spare[0]:], rnd.integers(0, 2**36, spare[1], dtype="<u8")])
            x, y = np.unique(x), np.unique(y)
            common = len(np.intersect1d(x, y))
            if 10 * common >= 9 * (len(x) + len(y) - common) and common < max(len(x), len(y)):
                assert set(jaccard.keys_of(x, len(x), levels)) & set(jaccard.keys_of(y, len(y), levels))
            bits = [np.frombuffer(linking.parity(s), "<u8") for s in (x, y)]
            assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(x) + len(y) - 2 * common
