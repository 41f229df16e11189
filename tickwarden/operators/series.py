"""Ordered work on per-key series that stays parallel when one key holds most of the rows.

A plain window sends a whole key to one task. The helpers here first ask how many rows the
hottest key has. Below `MAX_SERIES_ROWS` the plain window is used. Above it the rows get their exact position
from a range-partitioned sort, and frames run over fixed-size chunks of positions that carry the few
neighbouring rows ("halo") their frame reaches into, so results are the same and no task sees a whole key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwarden.session import cut

MAX_SERIES_ROWS = 2_000_000
CHUNK_ROWS = 65_536


def hottest(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest key: one partial aggregate over the key columns, one number to the driver."""
    return int(df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()["n"] or 0)


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int = MAX_SERIES_ROWS, known: int | None = None
) -> DataFrame:
    """Add `pos`, the 0-based rank of a row within its key. `order` must be a total order per key."""
    size = hottest(df, keys) if known is None else known
    if size <= max_rows:
        ordered = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn("pos", (F.row_number().over(ordered) - 1).cast("long"))
    # The global sort splits a hot key over many range partitions; the id holds (partition, offset).
    # It is written once, because a recomputed sample could draw other range bounds.
    placed = cut(
        df.orderBy(*keys, *order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", 33))
    )
    spans = placed.groupBy(*keys, "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    return (
        placed.join(spans.drop("_n"), [*keys, "_part"])
        .withColumn("pos", F.col("_id") - F.col("_first") + F.col("_before"))
        .drop("_id", "_part", "_first", "_before")
    )


def chunked(positioned: DataFrame, before: int, after: int = 0, size: int = CHUNK_ROWS) -> DataFrame:
    """Repeat the rows near a chunk's edge into the neighbour that needs them; `halo` marks the repeats."""
    size = max(size, before, after, 1)
    own = F.floor(F.col("pos") / size).cast("long")
    offset = F.col("pos") - own * size
    places = [own]
    if before:
        places.append(F.when(offset >= size - before, own + 1))
    if after:
        places.append(F.when((offset < after) & (own > 0), own - 1))
    spread = positioned.withColumn("_own", own).withColumn("chunk", F.explode(F.array_compact(F.array(*places))))
    return spread.withColumn("halo", F.col("chunk") != F.col("_own")).drop("_own")


def over_series(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Callable[[object], dict[str, Column]],
    before: int,
    after: int = 0,
    max_rows: int = MAX_SERIES_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Add window columns whose frames reach at most `before` rows back and `after` rows ahead.

    `columns(w)` gets the ordered window without a frame and returns the new columns. `sized_by` is a cheaper table
    with at least as many rows per key, to count instead of `df`.
    """
    size = hottest(df if sized_by is None else sized_by, keys)
    if size <= max_rows:
        return df.withColumns(columns(Window.partitionBy(*keys).orderBy(*order)))
    placed = chunked(with_position(df, keys, order, max_rows, size), before, after, chunk_rows)
    window = Window.partitionBy(*keys, "chunk").orderBy("pos")
    return placed.withColumns(columns(window)).where(~F.col("halo")).drop("pos", "chunk", "halo")


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The newest `n` rows per key. The rank filter is applied before the shuffle, so hot keys shrink first."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n).drop("_rank")


def best_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | None, rank: str = "rank"
) -> DataFrame:
    """The first `n` rows per key under `order` (all rows for None), with their rank."""
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(window))
    return ranked if n is None else ranked.where(F.col(rank) <= n)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row per key (duplicate removal) with a map-side combined aggregate."""
    others = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*others), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)
