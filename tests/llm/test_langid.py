from __future__ import annotations

import random


from tickwarden.llm import langid

SCHEMA = "doc_id long, text string, lang string, lang_pred string, score int"
PARTS = {"aa": ["the", "ing", "and", "tion", "of"], "bb": ["der", "ung", "sch", "keit", "ü"], "cc": ["que", "ción", "ñ", "los", "mente"], "dd": ["ありがとう", "です", "ます", "日本", "語"]}


def text(rnd, lang, n):
    return " ".join("".join(rnd.choice(PARTS[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def data():
    rnd = random.Random(2)
    rows = [(i, text(rnd, lang, rnd.randrange(8, 60)), lang, "x", 1) for i in range(240) for lang in [list(PARTS)[i % 4]]]
    return rows + [(500, None, "aa", "", 0), (501, "", None, "", 0), (502, "12 34 !!", "aa", "", 0), (503, text(rnd, "bb", 20000).upper(), None, "", 0),
                   (None, text(rnd, "cc", 30), None, "", 0), (3, rows[3][1], "dd", "", 0)]


def test_languages_of_held_out_texts(spark):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA)
    samples = langid.fit(langid.training_rows(df))
    assert [s[0] for s in samples] == list(PARTS)
    got = langid.identify(df, samples).select("row.doc_id", "lang_pred", "score").collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, t, lang, *_ in rows[:240]:
        assert by_id[i]["lang_pred"] == lang and 0.5 <= by_id[i]["score"] <= 1
    for i in (500, 501, 502):
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0)
    assert by_id[503]["lang_pred"] == "bb" and by_id[None]["lang_pred"] == "cc"


def test_nothing_learned_and_no_rows(spark):
    df = spark.createDataFrame(data()[:5], SCHEMA)
    assert {r["lang_pred"] for r in langid.identify(df, ()).collect()} == {"und"}
    assert langid.fit(langid.training_rows(df.limit(0))) == ()
    assert langid.identify(df.limit(0), (("aa", "abc"),)).count() == 0


def brute_phrases(sample, text):
    """Greedy phrases by substring search in the whole text."""
    count, i = 0, 0
    while i < len(text):
        n = 0
        while i + n < len(text) and text[i:i + n + 1] in sample:
            n += 1
        i += max(1, n)
        count += 1
    return count


def costs(model, texts):
    """Phrases of each text, read through the batches of the model."""
    seen = {}
    parse = model._parse

    def kept(whole, owner, totals, states, goes_on):
        seen["totals"] = totals
        return parse(whole, owner, totals, states, goes_on)

    model._parse = kept
    list(model.predict(texts))
    return seen["totals"][0].astype(int).tolist()


def cleaned(text, kinds):
    return "".join(map(chr, langid.plain(text, kinds)))


def test_phrases_match_substring_search(monkeypatch):
    monkeypatch.setattr(langid, "LANES", 7)  # texts go on in the next batch of blocks
    rnd = random.Random(9)
    kinds = langid._letters()
    sample = "".join(rnd.choice("abcd ") for _ in range(3000))
    model = langid.Model((("x", sample),))
    texts = ["".join(rnd.choice("abcde ") for _ in range(n)) + "a" for n in (0, 4, 300, 510, 511, 512, 1500, 9000, 40)]
    texts += [sample[100:2900], sample + sample[::-1] + sample, "ab cd " * 1500, "a" * 3000, sample[5:600] + "é" + sample[7:1200]]
    assert costs(model, texts) == [brute_phrases(cleaned(sample, kinds), cleaned(t, kinds)) for t in texts]
    assert costs(model, [sample[100:2900]])[0] == 1  # one phrase over six blocks


def test_all_letters_of_a_large_script_are_told_apart():
    rnd = random.Random(4)
    kinds = langid._letters()
    letters = [chr(0x4E00 + i) for i in range(3000)] + list("ab ")
    sample = "".join(rnd.choice(letters) for _ in range(9000))
    model = langid.Model((("x", sample),))
    texts = [sample[k:k + 40] + "".join(rnd.choice(letters) for _ in range(30)) + sample[k // 2:k // 2 + 700] for k in range(0, 8000, 400)]
    texts += ["".join(rnd.choice(letters) for _ in range(1300)), chr(0x9000) * 5 + sample[:20]]
    assert costs(model, texts) == [brute_phrases(cleaned(sample, kinds), cleaned(t, kinds)) for t in texts]


def test_two_languages_of_one_large_script(spark):
    rnd = random.Random(8)
    words = {k: ["".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(2)) for _ in range(400)] for k in ("one", "two")}
    rows = [(i, "".join(rnd.choice(words[k]) for _ in range(30)), k, "", 0) for i in range(160) for k in [("one", "two")[i % 2]]]
    df = spark.createDataFrame(rows, SCHEMA)
    got = langid.identify(df, langid.fit(langid.training_rows(df))).select("row.lang", "lang_pred").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)


def test_a_language_of_long_texts_only_is_learned(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([(i, text(rnd, lang, 9000 if lang == "aa" else 40), lang, "", 0) for i in range(12) for lang in ("aa", "bb")], SCHEMA)
    samples = langid.fit(langid.training_rows(df))
    assert [s[0] for s in samples] == ["aa", "bb"] and all(len(s[1]) > 500 for s in samples)


def test_automaton_reads_exactly_the_substrings():
    rnd = random.Random(1)
    s = [rnd.randrange(3) for _ in range(60)]
    move = langid.automaton(s)
    subs = {tuple(s[i:j]) for i in range(len(s)) for j in range(i + 1, min(len(s), i + 7) + 1)}
    import itertools
    for n in range(1, 7):
        for w in itertools.product(range(3), repeat=n):
            state, ok = 0, True
            for c in w:
                if c not in move[state]:
                    ok = False
                    break
                state = move[state][c]
            assert ok == (w in subs)
