from __future__ import annotations

import hashlib
import math
import random

import numpy as np

from tickwarden.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, v string, key int"


def plain(rows):
    """The contract by loops over whole numbers."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(min(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[1])
    kept = [r for r in kept if len(r[1]) == width]
    d = width // 16
    part = lambda v, p: v[p * d:(p + 1) * d]
    first = {}
    for r in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(r[0], r[1])
    books = [[part(v, p) for v in list(first.values())[:64]] for p in range(16)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, p: min((gap(part(v, p), e), n) for n, e in enumerate(books[p]))
    for _ in range(2):
        new = []
        for p in range(16):
            members = [[] for _ in books[p]]
            for _, v, _ in kept:
                members[nearest(v, p)[1]].append(part(v, p))
            new.append([[sum(c) // len(m) for c in zip(*m)] if m else e for m, e in zip(members, books[p])])
        books = new
    total, out = {}, []
    for i, v, label in kept:
        found = [nearest(v, p) for p in range(16)]
        error = sum(f[0] for f in found)
        total[label] = total.get(label, 0) + error
        out.append((i, "".join(f"{f[1]:02x}" for f in found), error, label))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), c, e, total[label], digest) for i, c, e, label in out)


def run(spark, rows):
    got = codes.encode(spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA).repartition(4))
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got.collect())


def test_codes_equal_the_loops(spark):
    rnd = random.Random(1)
    number = lambda: float(np.float32(rnd.choice([rnd.gauss(0, 0.2), rnd.choice([-0.25, 0.0, 0.5])])))
    rows = [(i, [number() for _ in range(48)], rnd.choice([0, 0, 0, 1, None])) for i in range(300)]
    rows += [(3, rows[7][1], 1), (7, rows[7][1], 2), (7, rows[7][1], 2), (None, rows[9][1], 5), (900, None, 1), (901, [], 1), (902, [0.5] * 32, 1)]
    rows += [(-5, [math.nan] + [0.0] * 47, 0), (-6, [None] + [0.0] * 47, 0), (-7, [math.inf] + [0.0] * 47, 0)]
    assert run(spark, rows) == plain(rows)


def test_few_rows_no_rows_and_lengths_that_cannot_be_cut(spark):
    few = [(i, [float(i % 3)] * 16, None) for i in range(5)]
    assert run(spark, few) == plain(few)
    assert run(spark, [(1, [0.5] * 17, 1)]) == [] and run(spark, [(1, None, 1)]) == [] and run(spark, []) == []
    big = run(spark, [(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1)])
    assert [b[2] for b in big] == [0, 0]


def test_masks_leave_the_nearest_entry_among_the_candidates():
    rnd = np.random.default_rng(2)
    for n, d in ((1, 1), (64, 1), (64, 4), (17, 6)):
        s = codes.Slices(rnd.integers(-20, 20, (n, d)))
        x = rnd.integers(-40, 40, (500, d))
        gaps = ((x[:, None] - s.entries[None]) ** 2).sum(axis=2)
        at, best = s.nearest(x)
        assert (at == gaps.argmin(axis=1)).all() and (best == gaps.min(axis=1)).all()
        if n == 64 and d == 4:
            assert np.bitwise_count(s.candidates(x, s.radius(x))).mean() < 40
