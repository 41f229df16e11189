from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tickwarden.llm import graph, linking, simhash

SCHEMA = "doc_id long, text string, print string, key int"


def brute(rows):
    def one(text):
        w = [] if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        if not w:
            return 0
        sh = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    prints = [one(t) for _, t in rows]
    return prints, classes(prints, [i for i, _ in rows])


def classes(prints, ids):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(prints))]


def test_cluster_matches_brute_force(spark):
    rnd = random.Random(1)
    words = [f"w{i}É" for i in range(40)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (3, "one"), (4, "one two"), (None, "one two three"), (5, "one two three"), (6, "one two")]
    for i in range(10, 130):
        base = [rnd.choice(words) for _ in range(120)]
        rows.append((i, " ".join(base)))
        if i % 3 == 0:
            base[rnd.randrange(120)] = "changed"
            rows.append((i + 1000, " ".join(base)))
        if i % 5 == 0:
            rows.append((i + 2000, "\n".join(base).upper()))
    rows.append((9999, "long " * 70000))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    prints, ids = brute(rows)
    got = sorted(map(tuple, simhash.cluster(df).collect()), key=str)
    want = sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, ids)), key=str)
    assert got == want
    assert simhash.cluster(df.limit(0)).count() == 0


def test_links_keep_every_connection_in_plain_and_crowded_keys(spark):
    rnd = random.Random(2)
    near = lambda p: p ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64))
    prints = {0, 3, 7}
    for _ in range(30):
        p = rnd.getrandbits(64)
        for _ in range(6):
            prints.add(p)
            p = near(p)
    base = rnd.getrandbits(64)
    crowd = {base ^ (rnd.getrandbits(11) << 43) ^ (rnd.randrange(2) << 25) for _ in range(900)}
    prints = sorted(prints | crowd)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "print long"))
    for a, b in edges.collect():
        assert 0 < ((a ^ b) & (2**64 - 1)).bit_count() <= 2
    roots = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    got = {}
    for p in signed:
        got.setdefault(roots.get(p, p), set()).add(p)
    want = {}
    for p, c in zip(signed, classes(prints, signed)):
        want.setdefault(c, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 300)] + [(7, j) for j in range(400, 500)] + [(5, 5), (400, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 301)}, **{i: 7 for i in [7, *range(400, 500)]}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hash_is_the_published_one(spark):
    shown = spark.range(1).select(F.xxhash64(F.lit("abc")).alias("h")).first()["h"]
    assert shown & (2**64 - 1) == xxhash.xxh64_intdigest(b"abc", 42)


def test_similar_texts_are_found_and_others_left_alone(spark):
    rnd = random.Random(8)
    vocabulary = [f"word{i}" for i in range(4000)]
    base = {i: [rnd.choice(vocabulary) for _ in range(rnd.choice([60, 150, 400]))] for i in range(60)}
    rows, group = [(i, " ".join(w)) for i, w in base.items()], {i: i for i in base}
    for i in range(0, 40):
        w = list(base[i])
        for _ in range(max(1, len(w) // 90)):
            w[rnd.randrange(len(w))] = "Changed" + str(rnd.randrange(99))
        rows.append((1000 + i, " ".join(w)))
        group[1000 + i] = i
        if i % 4 == 0:
            rows.append((2000 + i, "\n".join(base[i]).upper()))
            group[2000 + i] = i
    crowd = [rnd.choice(vocabulary) for _ in range(200)]
    for i in range(400):
        w = list(crowd)
        w[i % 200] = f"x{i}"
        rows.append((5000 + i, " ".join(w)))
        group[5000 + i] = 5000
    rows += [(9000, None), (9001, " "), (9002, "two words"), (9003, "two words"), (9004, "two other")]
    group.update({9000: 9000, 9001: 9000, 9002: 9002, 9003: 9002, 9004: 9004})
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(df).collect()}
    assert got.keys() == group.keys()
    assert all(group[i] == group[c] for i, c in got.items())
    assert sum(group[i] == c for i, c in got.items()) >= 0.97 * len(got)
    assert all(got[5000 + i] == 5000 for i in range(400))
    assert [got[i] for i in range(9000, 9005)] == [9000, 9000, 9002, 9002, 9004]
    assert simhash.similar(df.limit(0)).count() == 0


def test_similar_finds_appended_and_cut_passages(spark):
    rnd = random.Random(9)
    vocabulary = [f"word{i}" for i in range(6000)]
    rows, wanted = [], {"0.80": [], "0.85": [], "0.90": []}
    for i in range(240):
        w = [rnd.choice(vocabulary) for _ in range(rnd.choice([80, 300, 1200]))]
        band = ["0.80", "0.85", "0.90"][i % 3]
        n = int(len(w) * (1 / (float(band) + 0.02) - 1))
        passage = [f"more{i}x{j}" for j in range(n)]
        other = [w + passage, passage + w, w[:len(w) - int(len(w) * (0.98 - float(band)))]][i // 3 % 3]
        rows += [(i, " ".join(w), "x", 1), (1000 + i, " ".join(other), "x", 1)]
        wanted[band].append(i)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {band: sum(got[1000 + i] == i for i in ids) for band, ids in wanted.items()} == {band: 80 for band in wanted}


def test_similar_tells_copies_of_one_word_set_apart(spark):
    rnd = random.Random(10)
    vocabulary = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(120):
        w = rnd.sample(vocabulary, 300)
        rows += [(i, " ".join(w), "x", 1), (1000 + i, " ".join(w[:-2] + w[:-3:-1]), "x", 1)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == got[1000 + i] == i for i in range(120))


@pytest.mark.parametrize("block", [linking.BLOCK, 40])
def test_similar_finds_families_that_share_a_crowd(spark, monkeypatch, block):
    monkeypatch.setattr(linking, "BLOCK", block)
    rnd = random.Random(11)
    passage = [f"word{i}" for i in range(200)]
    rows = []
    for family in range(12):
        own = [f"own{family}x{i}" for i in range(60)]
        for copy in range(150):
            w = passage + own
            for _ in range(rnd.randrange(4)):
                w[rnd.randrange(len(w))] = f"x{family}x{copy}"
            rows.append((1000 * family + copy, " ".join(w), "x", 1))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(c == i // 1000 * 1000 for i, c in got.items())
