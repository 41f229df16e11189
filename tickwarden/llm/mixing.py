"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwarden.llm.words import row_of, words
from tickwarden.session import cut

SPREAD = 64  # parts into which equally long documents of one source are split


def spread(key: Column) -> Column:
    """A part number from 0 to SPREAD - 1; plain arithmetic, so that any SQL engine gives the same."""
    return F.pmod(F.pmod(F.coalesce(key.cast("long"), F.lit(-1)), F.lit(1000003)) * 7919, F.lit(SPREAD)).cast("int")


def offset(source: Column, seed: int) -> Column:
    """The source's random offset in [0, 1), a multiple of 2^-20."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("double") / 1048576.0


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target, rate).

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes. A target stops at
    `most` times its source; the rest is shared out again by weight. With sources in order of the level at which they
    reach that limit, the common level follows from two running sums. One row a source goes through one window.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1
    ranked = sizes.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), place).cast("double").alias("w"))
    ranked = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    level = ranked.select(
        "source", "source_size", "w", "cap", F.row_number().over(by_level).alias("at"),
        ((total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)).alias("level"),
    )
    open_ = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("at", "level"))
    level = level.withColumn("common", F.min(open_).over(everything)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("common") * F.col("w"), F.col("cap")))
    level = level.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    return level.select("source", "source_size", "target", rate.alias("rate"))


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[int] = (5, 2, 1), most: float = 3.0, seed: int = 7, size: str | None = None,
) -> DataFrame:
    """Decide how often each document is taken: (row, size, source_size, target, copies).

    `row` is the input row as a struct. The expected copies of a document are its source's rate; documents of a source
    stand in order of size, so each stretch of the order is sampled at the rate, and the n-th document is taken once
    for each integer in (offset + (n - 1) rate, offset + n rate]. `size` names a column that already holds word counts.

    A document's place is the sum of three counts: shorter documents of its source, equally long ones in lower parts,
    and its place in its own part. A hot source or a run of copies is thus spread over many tasks.

    Null text has size 0 and may be taken (0 words). Null source is a source of its own, last in order. Null keys sort
    first within their part. Repeated rows count once each. No rows give no rows. A source without words has target 0.
    """
    count = F.coalesce(docs[size].cast("long"), F.lit(0)) if size else F.size(words(docs[text])).cast("long")
    rows = docs.select(row_of(docs), docs[source].alias("source"), docs[key].alias("key"), count.alias("size"))
    rows = rows.withColumn("part", spread(F.col("key")))
    parts = cut(rows.groupBy("source", "size", "part").agg(F.count("*").alias("n")))

    by_part = Window.partitionBy("source", "size").orderBy("part")
    by_size = Window.partitionBy("source").orderBy("size")
    sizes = parts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sizes = sizes.select(F.col("source").alias("s_source"), F.col("size").alias("s_size"), (F.sum("n").over(by_size) - F.col("n")).alias("shorter"))
    totals = parts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(totals, weights, most).withColumnRenamed("source", "t_source")
    places = (
        parts.withColumn("lower", F.sum("n").over(by_part) - F.col("n"))
        .join(sizes, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("size") == F.col("s_size")))
        .join(targets, F.col("source").eqNullSafe(F.col("t_source")))
        .select(
            F.col("source").alias("p_source"), F.col("size").alias("p_size"), F.col("part").alias("p_part"),
            (F.col("shorter") + F.col("lower")).alias("first"), "source_size", "target", "rate",
        )
    )
    nth = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("key"))
    placed = rows.withColumn("nth", nth).join(
        places,
        F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")) & (F.col("part") == F.col("p_part")),
    )
    place, start = F.col("first") + F.col("nth"), offset(F.col("source"), seed)
    copies = F.floor(place * F.col("rate") + start) - F.floor((place - 1) * F.col("rate") + start)
    return placed.select("row", "size", "source_size", "target", copies.cast("int").alias("copies"))


def take(mixed: DataFrame) -> DataFrame:
    """The mix itself: each input row as often as it is taken."""
    return mixed.filter(F.col("copies") > 0).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
