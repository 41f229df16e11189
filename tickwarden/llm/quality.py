"""Quality by weak supervision: rules vote, expectation-maximisation weighs them, a posterior decides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwarden.llm.words import BREAKS, let, words
from tickwarden.session import cut

WINDOW = 5
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def repeated_words(tokens: Column) -> Column:
    """Number of words inside windows of five words that occur twice or more in the text, the first included.

    Windows are compared by a 64-bit hash. Only texts with a repeated hash are sorted.
    """
    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda x, k: F.coalesce(F.least(F.get(starts, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def repeats(ordered: Column) -> Column:
        same = F.filter(ordered, lambda x, k: F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(ordered, k - 1)["h"] == x["h"], F.lit(False)))
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    def of_hashes(w: Column) -> Column:
        hashes = F.transform(F.slice(w, 1, F.size(w) - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, WINDOW)]))
        ordered = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(ordered(h), repeats)))

    hashed = F.transform(tokens, lambda x: F.xxhash64(x))
    return F.when(F.size(tokens) <= WINDOW, 0).otherwise(let(hashed, of_hashes)).cast("long")


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_marks) of whole texts.

    n_lines counts lines with a word, n_capitals A-Z, n_marks exclamation and question marks. Null text counts as empty.
    """
    body = F.coalesce(docs[text], F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.translate(x, " " + BREAKS, "") != "")
    rows = docs.select(docs[key].alias(key), body.alias("body"), words(docs[text]).alias("tokens"), lines.alias("lines"))
    size = F.length("body")
    return rows.select(
        key, F.size("tokens").cast("long").alias("n_words"),
        _without(F.col("body"), " " + BREAKS).cast("long").alias("word_chars"),
        (size - _without(F.col("body"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("tokens")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (size - _without(F.col("body"), CAPITALS)).cast("long").alias("n_capitals"),
        (size - _without(F.col("body"), "!?")).cast("long").alias("n_marks"),
    )


@dataclass(frozen=True)
class Rule:
    """Votes bad (0) if `bad` holds, else good (2) if `good` holds, else abstains (1). Both are SQL over the measures.

    `least`: a bad vote counts as at least so many times likelier from a bad text, whatever the votes of other rules say.
    Kinds of junk seldom overlap, so agreement between rules alone cannot show how far a lone vote is to be trusted.
    """

    name: str
    bad: str
    good: str
    least: float

    def vote(self) -> Column:
        return F.when(F.expr(self.bad), 0).when(F.expr(self.good), 2).otherwise(1)


RULES = (
    Rule("many_symbols", "4 * n_symbols > n_words", "50 * n_symbols <= n_words", 50.0),
    Rule("symbols", "20 * n_symbols > n_words", "n_symbols = 0", 5.0),
    Rule("capitals", "10 * n_capitals > 4 * word_chars", "8 * n_capitals < word_chars and n_words > 0", 50.0),
    Rule("marks", "10 * n_marks > 3 * n_words", "50 * n_marks <= n_words and n_words > 0", 5.0),
    Rule("lines", "2 * n_dup_lines > n_lines", "n_dup_lines = 0 and n_lines > 1", 2.0),
    Rule("repeats", "100 * n_repeat_words > 15 * n_words", "n_repeat_words = 0 and n_words >= 50", 2.0),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 14 * n_words", "word_chars between 3 * n_words and 9 * n_words", 5.0),
)
START_SHARE = 0.8  # of good texts
START_GOOD_VOTE = 0.1  # ln(good / bad) of a good vote; a bad vote starts at its rule's least ratio
SHARES = (0.5, 0.9)  # bounds of the share of good texts
MOST_BAD, MOST_GOOD = 8.0, 0.3  # bounds of what one vote adds
ROUNDS = 40


@dataclass(frozen=True)
class Model:
    """ln(good / bad) before any vote, and what each rule's vote adds: bad, abstain, good, rule by rule."""

    prior: float
    weights: tuple[float, ...]


def fit(patterns: DataFrame, rules: tuple[Rule, ...], rounds: int = ROUNDS, most_good: float = MOST_GOOD, bounds: tuple[float, float] = SHARES) -> Model:
    """Expectation-maximisation over (votes array<int>, n): how often good and bad texts cast each vote.

    There are at most 3^rules patterns, whatever the number of texts; they are brought into one row, and the rounds run
    there as one fold. An abstention adds nothing, a bad vote at least its rule's least ratio, a good vote nothing below
    zero nor above `most_good`; the share of good texts keeps within `bounds`. Each share starts from one text a vote, so none becomes zero. Without texts the starting values remain.
    """
    ks = list(range(3 * len(rules)))
    grown = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("ps"))
    least = F.array(*[F.log(F.lit(r.least)) for r in rules])

    def weight(k: Column, good: Column, bad: Column, g: Column, b: Column) -> Column:
        ratio = F.log(((good + 1) / (g + 3)) / ((bad + 1) / (b + 3)))
        against = F.greatest(F.lit(-MOST_BAD), F.least(-F.get(least, F.floor(k / 3).cast("int")), ratio))
        return F.when(k % 3 == 0, against).when(k % 3 == 2, F.greatest(F.lit(0.0), F.least(F.lit(most_good), ratio))).otherwise(0.0)

    def posterior(state: Column, votes: Column) -> Column:
        logit = F.aggregate(F.transform(votes, lambda v, r: F.get(state["w"], r * 3 + v)), state["prior"], lambda a, x: a + x)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))

    def step(state: Column, ps: Column) -> Column:
        posts = F.transform(ps, lambda p: F.struct(p["votes"].alias("votes"), (p["n"] * posterior(state, p["votes"])).alias("g"), p["n"].alias("n")))
        total = lambda rows, f: F.aggregate(rows, F.lit(0.0), lambda a, x: a + f(x))

        def next_state(rows: Column) -> Column:
            g, n = total(rows, lambda x: x["g"]), total(rows, lambda x: x["n"])

            def finish(sums: Column) -> Column:
                all_g, all_n = sums["g"], sums["n"]
                share = F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), all_g / all_n))
                w = F.transform(F.array(*map(F.lit, ks)), lambda k: let(
                    F.filter(rows, lambda x: F.get(x["votes"], F.floor(k / 3).cast("int")) == k % 3),
                    lambda own: weight(k, total(own, lambda x: x["g"]), total(own, lambda x: x["n"] - x["g"]), all_g, all_n - all_g)))
                return F.struct(F.log(share / (1 - share)).alias("prior"), w.alias("w"))

            return let(F.struct(g.alias("g"), n.alias("n")), finish)

        return let(posts, next_state)

    start = [F.lit(0.0) - F.log(F.lit(rules[k // 3].least)) if k % 3 == 0 else F.lit(START_GOOD_VOTE if k % 3 == 2 else 0.0) for k in ks]
    first = F.struct(F.log(F.lit(START_SHARE) / F.lit(1 - START_SHARE)).alias("prior"), F.array(*start).alias("w"))
    turns = F.when(F.size("ps") > 0, F.sequence(F.lit(1), F.lit(rounds))).otherwise(F.array().cast("array<int>"))
    state = grown.select(F.aggregate(turns, first, lambda s, _: step(s, F.col("ps"))).alias("state")).first()["state"]
    return Model(state["prior"], tuple(state["w"]))


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """Add votes, the posterior `quality` (6 decimals), base_failed and kept to measures() rows.

    base_failed: under ten words, or over a fifth of the words repeated. kept: not base_failed, and quality of at least
    the threshold. The model is fitted on the votes of all rows. Empty and null texts fail the base. Repeated rows count
    as texts of their own. No rows give no rows.
    """
    voted = measured.withColumn("votes", F.array(*[r.vote() for r in rules]))
    model = fit(voted.groupBy("votes").agg(F.count("*").alias("n")), rules)
    weights = F.array(*map(F.lit, model.weights))
    logit = F.aggregate(F.transform("votes", lambda v, r: F.get(weights, r * 3 + v)), F.lit(model.prior), lambda a, x: a + x)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    quality = F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)), 6)
    return voted.withColumn("quality", quality).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= threshold))


def rate(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """measures() and judge() in one; the measures are written once and read for the fit and for the verdict."""
    return judge(cut(measures(docs, key, text)), rules)
