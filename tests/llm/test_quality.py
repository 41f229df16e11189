from __future__ import annotations

import random

from tickwarden.llm import quality

SCHEMA = "doc_id long, text string, n_words string, quality int, votes string"


def words_of(text):
    out, now = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            out, now = out + [now] * bool(now), ""
        else:
            now += c
    return out + [now] * bool(now)


def brute(text):
    w, text = words_of(text), text or ""
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def rows():
    rnd = random.Random(1)
    good = [" ".join(rnd.choice(["alpha", "beta", "gämma", "delta.", "of", "😀x", "the"]) for _ in range(rnd.randrange(12, 90))) for _ in range(60)]
    texts = [None, "", " \n\t", "a b c d e a b c d e a b", "x\ny\nx\n \nx", "one two three four five", "<a> #$% | * & b"]
    texts += good + [g.upper() + "!!" for g in good[:4]] + [" ".join(x + "###" for x in g.split()) for g in good[4:8]]
    texts += ["again and again we say it\n" * 40, "same " * 3000, "a\u2003b c\x0bd\x0ce\x1ff"]
    return [(i, t, "x", 1, "y") for i, t in enumerate(texts)] + [(None, good[0], "x", 1, "y"), (5, good[1], "x", 1, "y"), (5, good[1], "x", 1, "y")]


def test_counts_match_brute_force_and_junk_is_rejected(spark):
    data = rows()
    got = quality.rate(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    key = lambda r: tuple((x is None, x) for x in r)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted((tuple(r[n] for n in names) for r in got), key=key) == sorted(((d[0], *brute(d[1])) for d in data), key=key)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["kept"] for i in range(7, 67) if not by_id[i]["base_failed"])
    assert not any(by_id[i]["kept"] for i in range(67, 75))


def test_votes_of_few_or_no_texts(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.rate(empty).count() == 0
    one = quality.rate(spark.createDataFrame([(1, "just one short text of ten words or more than that", "", 0, "")], SCHEMA)).first()
    assert one["kept"] and 0 <= one["quality"] <= 1


def test_expectation_maximisation_recovers_planted_accuracies(spark):
    rnd = random.Random(2)
    rules = tuple(quality.Rule(n, "false", "false", 2.0) for n in "abcd")
    counts = {}
    for _ in range(20000):
        bad = rnd.random() < 0.3
        votes = tuple(0 if rnd.random() < (0.7 if bad else 0.05) else 2 for _ in rules)
        counts[votes] = counts.get(votes, 0) + 1
    model = quality.fit(spark.createDataFrame([(list(v), n) for v, n in counts.items()], "votes array<int>, n long"), rules, most_good=8.0)
    import math
    for r in range(4):
        assert abs(model.weights[3 * r] - math.log(0.05 / 0.7)) < 0.3
