"""URL rules found by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwarden.session import cut


@dataclass(frozen=True)
class Rule:
    """A regular expression over host and path, the literal tokens each match must hold, and what a match means.

    A literal is a run of a-z and 0-9 that every matching URL, lower-cased, holds as a whole token. Among the rules that
    match, the highest rank wins, then the longest name, then the last name in order.
    """

    name: str
    pattern: str
    literals: tuple[str, ...]
    verdict: str
    rank: int = 0
    shown: bool = True


def place_rule(verdict: str, place: str) -> Rule:
    """A rule for a host with its subdomains and the start of the path, written like `example.com/en/`."""
    host, _, path = place.partition("/")
    tokens = tuple(t for t in re.split("[^a-z0-9]+", place.lower()) if t)
    return Rule(place, rf"^(?:[^/]*\.)?{_plain(host)}{_plain('/' + path)}", tokens, verdict, rank=1)


def token_rule(verdict: str, token: str) -> Rule:
    """A rule for URLs that hold the token between other characters than a-z and 0-9."""
    return Rule(token, rf"(?i)(?:^|[^a-z0-9]){_plain(token)}(?:[^a-z0-9]|$)", (token,), verdict, shown=False)


def _plain(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


# Tokens of addresses that carry no article.
UNWANTED = ("adserver", "adservice", "casino", "clickserve", "doubleclick", "phishing", "popunder", "porn", "torrent", "tracker", "viagra", "warez", "xxx")
UNWANTED_RULES = [token_rule("block", t) for t in UNWANTED]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(like: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rules as rows (name, pattern, literals, verdict, rank, shown)."""
    rows = F.array(*[
        F.struct(
            F.lit(r.name).alias("name"), F.lit(r.pattern).alias("pattern"), F.array(*map(F.lit, r.literals)).alias("literals"),
            F.lit(r.verdict).alias("verdict"), F.lit(r.rank).alias("rank"), F.lit(r.shown).alias("shown"),
        ) for r in rules
    ])
    return like.sparkSession.range(1).select(F.inline(rows))


def judge(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url", otherwise: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) for every row.

    Each rule is filed under the one of its literals that the fewest distinct addresses hold. The tokens of an address
    fetch the rules filed under them, and only those are matched against it. Equal addresses are judged once.

    `rule` names the winning rule if it is of the kind that is shown, else it is null; without a match the verdict is
    `otherwise`. A rule without literals is an error. Null URLs and URLs without :// have an empty host and path and get `otherwise`. Null keys and repeated
    rows are kept. No rules or no rows are fine.
    """
    rows = pages.select(pages[key].alias("key"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    if not all(r.literals for r in rules):
        raise ValueError("each rule needs a literal token")
    if not rules:
        found = rows.select(F.col("key").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
        return found
    table = rule_table(pages, rules)
    address = F.concat("host", "path")
    tokens = F.array_distinct(F.array_remove(F.split(F.lower(address), "[^a-z0-9]+"), ""))
    held = cut(rows.select("host", "path").distinct().select("host", "path", F.explode(tokens).alias("token")).join(
        table.select(F.explode("literals").alias("token")).distinct(), "token", "left_semi"))
    counts = held.groupBy("token").agg(F.count("*").alias("n"))
    literals = table.select("name", F.explode("literals").alias("token")).join(counts, "token", "left")
    rarest = literals.groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    filed = table.join(rarest, "name")
    matches = held.join(filed, "token").filter(F.expr("rlike(concat(host, path), pattern)"))
    order = F.struct("rank", F.length("name").alias("length"), "name", "shown", "verdict")
    best = matches.groupBy("host", "path").agg(F.max(order).alias("best"))
    return rows.join(best, ["host", "path"], "left").select(
        F.col("key").alias(key), "host", "path",
        F.when(F.col("best.shown"), F.col("best.name")).alias("rule"),
        F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"),
    )
