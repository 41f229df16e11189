"""Words as all operators here count them: longest runs of characters other than space and U+0009 to U+000D."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BREAKS = "\t\n\x0b\x0c\r"
END = b"\n"  # a token that no word can equal


def words(text: Column) -> Column:
    """array<string> of a text's words; null has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), BREAKS, " " * len(BREAKS))
    return F.array_remove(F.split(spaced, " "), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; a null key counts as empty text."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def row_of(df: DataFrame) -> Column:
    """The whole row as one struct, so that its names cannot clash with working columns."""
    return F.struct(*[df[c] for c in df.columns]).alias("row")


def lower_words(text: str | None) -> list[bytes]:
    """A text's words as UTF-8 with A-Z lower-cased; None has none. bytes.split breaks at exactly the six characters.

    Lone surrogates, which no Parquet string holds, become question marks.
    """
    return [] if text is None else text.encode("utf-8", "replace").lower().split()
