from __future__ import annotations

import random

import __spark_entry__ as entry
import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture(spark, folder):
    rnd = random.Random(7)
    parts = {"en": ["the", "ing", "and", "tion"], "de": ["der", "ung", "sch", "keit"]}
    rows, labels = [], []
    for i in range(400):
        lang = "en" if i % 3 else "de"
        w = ["".join(rnd.choice(parts[lang]) for _ in range(rnd.randrange(1, 5))) for _ in range(rnd.randrange(60, 200))]
        if i % 5 == 0:
            for _ in range(len(w) // 20):
                w.insert(rnd.randrange(len(w)), rnd.choice(["vile", "rotten", "wretch"]))
        rows.append([i, " ".join(w), lang, f"s{i % 4}", 0])
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [[1000 + i, rows[i][1], rows[i][2], "s9", 0] for i in range(0, 60)]  # exact copies
    for i in range(101, 131):  # near copies
        w = rows[i][1].split()
        w[len(w) // 2] = "other"
        rows.append([2000 + i, " ".join(w), rows[i][2], "s2", 0])
    rows += [[3000, None, None, None, None], [3001, "12 34", None, "s1", 5], [3002, "", "en", "s1", 0], [1, rows[1][1], "en", "s1", 0]]
    docs = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages_drop_what_they_should_and_keep_the_rest(spark, tmp_path):
    docs = fixture(spark, str(tmp_path))
    after = {}
    for name, stage in cp.STAGES:
        docs = cp.cut(stage(spark, docs, str(tmp_path)))
        after[name] = docs
    assert list(after) == ["toxicity", "language", "near_duplicates", "mixing", "packing"]
    for name in list(after)[:-1]:
        assert after[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {n: sorted(r["doc_id"] for r in d.select("doc_id").collect()) for n, d in after.items()}
    toxic = {i for i in range(400) if i % 5 == 0} | {1000 + i for i in range(0, 60, 5)} | {2000 + i for i in range(101, 131) if i % 5 == 0}
    clean = [i for i in [*range(400), *range(1000, 1060), *range(2101, 2131), 1] if i not in toxic]
    assert sum(i not in ids["toxicity"] for i in toxic) >= 0.97 * len(toxic)
    assert [i for i in ids["toxicity"] if i not in toxic and i < 3000] == sorted(clean)
    assert [i for i in ids["language"] if i not in toxic] == sorted(clean)
    left = [i for i in ids["near_duplicates"] if i not in toxic]
    assert [i for i in left if i < 1000] == [i for i in range(400) if i % 5] and not any(1000 <= i < 2000 for i in left)
    assert sum(i >= 2000 for i in left) <= 2
    assert set(ids["mixing"]) <= set(ids["near_duplicates"])
    packed = after["packing"]
    assert packed.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert set(ids["packing"]) == set(ids["mixing"])


def test_registered_with_the_other_queries():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert {n for n in entry.oracle_sql() if n.startswith("op")} >= {"op1_quality_rules", "op5_mix_sources", "op7_topk_search", "op10_url_filters"}
