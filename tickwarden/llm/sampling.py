"""Bounded samples of labelled documents, from which classifiers are fitted."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALT = 20
SPARE = 4  # times the rows wanted that the cut by hash leaves of a large label, on average


def _cuts(sizes: dict[object, int], most: int) -> list[tuple[object, int]]:
    """(label, highest hash) such that about SPARE * most rows of each label stay below; all of a label of fewer rows."""
    return [(label, -(1 << 63) + min((1 << 64) - 1, (SPARE * most << 64) // n)) for label, n in sizes.items()]


def sample(
    texts: DataFrame, labels: DataFrame | None, rows: int, characters: int, longest: int, pieces: bool = False
) -> list[tuple[object, object, str]]:
    """(label, key, text) of up to `rows` different texts a label, in the order of a hash of the key.

    `texts` has key and text, `labels` key and label; without `labels`, `texts` has the label itself. Null and empty texts
    are left out; texts longer than `longest` characters are too, or with `pieces` give that many characters from a place
    that the hash of the key names. A label's texts stop once `characters` are reached. So at most labels * (characters +
    longest) characters reach the driver, however large the table is. Equal texts count once. The order does not depend on
    partitioning.

    Only keys, hashes and lengths are joined and ranked; texts follow for the chosen ones. Labels are counted first, and
    of a large one only rows of low hashes are ranked, so no task gets a whole label. Should too few of them have a text,
    that label is ranked in full: the sample is the same with and without the cut.
    """
    order = F.xxhash64(F.lit(SALT), F.col("key").cast("string"))
    if pieces:
        place = F.pmod(order, F.greatest(F.length("text") - longest, F.lit(0)) + 1) + 1
        texts = texts.withColumn("text", F.col("text").substr(place.cast("int"), F.lit(longest)))
    usable = texts.filter((F.length("text") > 0) & (F.length("text") <= longest))
    marks = [F.xxhash64("text").alias("h"), F.length("text").alias("n"), order.alias("at")]
    most = 2 * rows  # leaves room for copies
    marked = texts if labels is None else labels
    sizes = {r["label"]: r["count"] for r in marked.filter("label is not null").groupBy("label").count().collect()}
    if not sizes:
        return []

    def first(cuts: list[tuple[object, int]]) -> list:
        known = texts.sparkSession.createDataFrame(cuts, f"label {marked.schema['label'].dataType.simpleString()}, highest long")
        low = order <= F.col("highest")
        if labels is None:
            slim = usable.join(F.broadcast(known), "label").filter(low).select("label", "key", *marks)
        else:
            slim = usable.select("key", *marks).join(labels.join(F.broadcast(known), "label").filter(low).select("key", "label"), "key")
        place = F.row_number().over(Window.partitionBy("label").orderBy("at", "h"))
        return slim.withColumn("r", place).filter(F.col("r") <= most).collect()

    ranked = first(_cuts(sizes, most))
    got = Counter(r["label"] for r in ranked)
    short = {label for label, n in sizes.items() if n > SPARE * most and got[label] < most}
    if short:
        ranked = [r for r in ranked if r["label"] not in short] + first([(label, (1 << 63) - 1) for label in short])
    chosen, used, count = {}, {}, {}
    for row in sorted(ranked, key=lambda r: (str(r["label"]), r["r"])):
        label, mark = row["label"], (row["label"], row["h"])
        if mark in chosen or used.get(label, 0) >= characters or count.get(label, 0) >= rows:
            continue
        chosen[mark] = row["key"]
        used[label] = used.get(label, 0) + row["n"]
        count[label] = count.get(label, 0) + 1
    if not chosen:
        return []
    keys = texts.sparkSession.createDataFrame([(k, h) for (_, h), k in chosen.items()], f"key {texts.schema['key'].dataType.simpleString()}, h long").distinct()
    found = usable.select("key", "text", F.xxhash64("text").alias("h")).join(F.broadcast(keys), ["key", "h"], "left_semi")
    text_of = {r["h"]: r["text"] for r in found.dropDuplicates(["h"]).collect()}
    return [(label, key, text_of[h]) for (label, h), key in sorted(chosen.items(), key=lambda x: (str(x[0][0]), str(x[1]), x[0][1])) if h in text_of]
