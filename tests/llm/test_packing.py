from __future__ import annotations

import random
import unicodedata
import zlib

import numpy as np

from tickwarden.llm import packing

SCHEMA = "doc_id long, text string, length string, ids int, start int, left string, key long"


def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_encoder_gives_the_ids_of_the_file(monkeypatch):
    encode, mine = plain(), packing.Encoder(packing.vocabulary_path())
    rnd = random.Random(3)
    texts = ["", " ", "a  b", " \n x", "don't we'll 12ab", "<|endoftext|>", "中文字 テキスト", "\u0085x\xa0 y", "x" * 5000, "\U0001f600 hi", "á́"]
    texts += ["".join(rnd.choice(" \n\t\xa0a1.'é　ßЖ") for _ in range(rnd.randrange(60))) for _ in range(1500)]
    added = ["<|endoftext|>", "<|endoftext|", " ", "  ", "a", "\n", "b.", "é"]
    texts += ["a <|endoftext|> b", *("".join(rnd.choice(added) for _ in range(rnd.randrange(1, 12))) for _ in range(1500))]
    assert mine.ids("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
    for chunk in (1 << 20, 5, 1):
        monkeypatch.setattr(packing, "CHUNK", chunk)
        for t in texts:
            assert mine.ids(t).tolist() == encode(t)


def test_both_libraries_part_all_quick_characters_alike():
    encode, mine = plain(), packing.Encoder(packing.vocabulary_path())
    quick = [chr(c) for c in range(0x2100) if not packing.OTHER.match(chr(c)) and unicodedata.category(chr(c)) != "Cs"]
    for c in quick:
        for t in (f"a{c}b", f" {c}{c} 1{c}", f"{c} \n{c}.{c}"):
            assert not packing.OTHER.search(t)
            assert mine.ids(t).tolist() == encode(t)


def test_pack_keeps_every_id_in_one_gapless_place(spark):
    encode, rnd = plain(), random.Random(4)
    rows = [(0, None), (1, ""), (2, "x " * 9000), (None, "no key"), (3, "same"), (3, "same")]
    rows += [(i, " ".join(rnd.choice(["alpha", "beta", "gamma,", "ü"]) for _ in range(rnd.randrange(1, 900)))) for i in range(10, 400)]
    df = spark.createDataFrame([(i, t, "x", 7, 1, "y", 2) for i, t in rows], SCHEMA).repartition(5, "doc_id")
    got = [r.asDict() for r in packing.pack(df, limit=4, with_ids=True).collect()]
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append((encode(t) if t else []) + [0])
    by_doc = {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        by_doc.setdefault(r["doc_id"], []).append((r["start"], ids.tolist(), r["doc_tokens"]))
    assert by_doc.keys() == texts.keys()
    for i, ps in by_doc.items():
        if len(texts[i]) > 1:
            assert sorted(x for p in ps for x in p[1]) == sorted(x for t in texts[i] for x in t)
            continue
        ps.sort()
        assert [x for p in ps for x in p[1]] == texts[i][0] and {p[2] for p in ps} == {len(texts[i][0])}
        assert [p[0] for p in ps] == [sum(len(q[1]) for q in ps[:n]) for n in range(len(ps))]
    windows = {}
    for r in got:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for w in windows.values():
        w.sort()
        assert [o for o, _ in w] == [sum(n for _, n in w[:k]) for k in range(len(w))]
        assert sum(n for _, n in w) <= 1024
    total = sum(r["length"] for r in got)
    assert len(windows) * 1024 < 1.08 * total + 1024
    assert packing.pack(df.limit(0)).count() == 0


def test_windows_fill_best_fit_and_close_the_fullest():
    w = packing.Windows(10, 2)
    assert w.put("a", 6) is None and w.put("b", 7) is None
    assert w.put("c", 3) is None and w.free[0] == (0, 1)
    serial, closed = w.put("d", 9)
    assert serial == 1 and [p[0] for p in closed] == ["b", "c"]
