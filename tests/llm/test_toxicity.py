from __future__ import annotations

import random
import zlib

from tickwarden.llm import toxicity

SCHEMA = "doc_id long, text string, score string, predicted int, row int"


def data(n=700):
    rnd = random.Random(6)
    plain = [f"word{i}" for i in range(300)] + ["the", "of", "and"] * 60
    rows, labels = [], []
    for i in range(n):
        w = [rnd.choice(plain) for _ in range(rnd.randrange(15, 120))]
        bad = i % 6 == 0
        if bad:
            for _ in range(max(1, len(w) // 30)):
                w.insert(rnd.randrange(len(w)), rnd.choice(["Vile,", "rotten", "WRETCH!"]))
        rows.append((i, " ".join(w), "x", 5, 6))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_texts_are_told_apart(spark):
    rows, labels = data()
    docs = spark.createDataFrame(rows + [(900, None, "", 0, 0), (901, "", "", 0, 0), (902, "!!! ...", "", 0, 0), (None, "rotten vile wretch", "", 0, 0),
                                        (903, "the of " * 60000, "", 0, 0), (5, rows[5][1], "", 0, 0)], SCHEMA)
    marked = spark.createDataFrame(labels + [(900, 1, 1), (None, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marked)
    out = toxicity.rate(docs, model).select("row.doc_id", "score", "predicted")
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == 706 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(got[i]["predicted"] == labels[i][2] for i in held)
    assert right >= 0.97 * len(held)
    assert got[None]["predicted"] == 1 and not any(got[i]["predicted"] for i in (900, 901, 902, 903))


def test_labels_are_no_input_and_held_out_ones_are_not_learned(spark):
    rows, labels = data(150)
    docs = spark.createDataFrame(rows, SCHEMA)
    fields = "doc_id long, quality int, toxic int"
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    one, two = (toxicity.rate(docs, toxicity.fit(docs, spark.createDataFrame(x, fields))).select("row.doc_id", "score").collect() for x in (labels, flipped))
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_without_labels_or_rows(spark):
    rows, labels = data(20)
    docs = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.rate(docs, toxicity.fit(docs, none)).collect()} == {0}
    one_kind = spark.createDataFrame([(i, 0, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.rate(docs, toxicity.fit(docs, one_kind)).collect()} == {0}
    assert toxicity.rate(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0


def test_model_matches_its_formulas():
    import math
    toxic, ordinary = [["a", "vile", "b"]] * 30, [["a", "good", "b"]] * 30
    m = toxicity.Model(toxic, ordinary)
    places, kinds = 5, 4  # different pairs: (,a) (a,vile) (vile,b) (a,good) (good,b); words: a vile b good
    backoff = 0.75 * kinds / places
    shared = 0.25 / places + backoff / (kinds + 1)
    want = math.log(((30 - 0.75) / 90 + backoff * shared) / (backoff * shared))
    assert abs(m.word[m.ids["vile"]] - want) < 1e-5
    assert "a" not in m.ids or m.word[m.ids["a"]] == 0
    assert m.measure([["unseen", "words"], []]).tolist() == [[0, 0], [0, 0]]
