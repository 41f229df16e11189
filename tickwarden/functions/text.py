"""Keyword rules, payload parsing and text templates (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwarden.functions.severity import clamp

# Keyword lists, tested in this order.
OUTCOME_KEYWORDS = [
    ("ddos_surge", ("ddos", "surge")),
    ("misconfiguration", ("misconfig", "rollback")),
    ("fiber_cut", ("down", "fiber")),
    ("hardware_degradation", ("hardware", "temperature", "cpu")),
]
DECISION_KEYWORDS = [
    ("ddos", ("ddos", "surge", "flood", "attack")),
    ("misconfiguration", ("misconfig", "configuration", "rollback", "route leak")),
    ("link_down", ("link down", "fiber cut", "down", "disconnected")),
    ("hardware", ("hardware", "temperature", "cpu", "memory", "buffer")),
    ("congestion", ("utilization", "congestion", "latency", "packet_loss")),
]
SEVERITY_KEYWORDS = [("critical", ("critical",)), ("high", ("high",)), ("low", ("low",))]
EXAMPLE_ROLE_PROMPT = (
    "You watch over a provider's network. Given what was measured and what was found unusual, "
    "say which single action you would take, and why."
)
OUTCOME_NOTES = {
    "effective": "Afterwards the readings were back to normal.",
    "partially_effective": "Afterwards some readings were better, others were not.",
    "ineffective": "Afterwards nothing had improved; try something else.",
    "harmful": "Afterwards things were worse; do not repeat this here.",
}


def joined(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *parts))


def classify(text: Column, rules: list[tuple[str, tuple[str, ...]]], otherwise: str, whole_words: bool) -> Column:
    """First rule with a keyword in `text`. Whole-word matching keeps "down" from matching "downstream"."""
    expr = None
    for label, words in rules:
        pattern = "|".join(words)
        test = text.rlike(rf"\b({pattern})" + (r"\b" if whole_words else "")) if whole_words else text.rlike(pattern)
        expr = F.when(test, label) if expr is None else expr.when(test, label)
    return expr.otherwise(F.lit(otherwise))


def outcome_class(text: Column, whole_words: bool = False) -> Column:
    return classify(text, OUTCOME_KEYWORDS, "congestion_cascade", whole_words)


def decision_class(text: Column, whole_words: bool = False) -> Column:
    return classify(text, DECISION_KEYWORDS, "congestion", whole_words)


def text_severity(text: Column) -> Column:
    return classify(text, SEVERITY_KEYWORDS, "medium", False)


def learning_title(summary: Column) -> Column:
    return F.concat(F.lit("Incident Learning: "), F.substring(summary, 1, 60), F.lit("..."))


def retrieval_question(metric: Column) -> Column:
    return F.concat(F.lit("troubleshooting "), metric, F.lit(" issues"))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat(user: Column, assistant: Column) -> Column:
    return F.array(
        message("system", F.lit(EXAMPLE_ROLE_PROMPT)), message("user", user), message("assistant", assistant)
    )


def unfence(text: Column) -> Column:
    """Drop a surrounding code fence and its language tag."""
    body = F.regexp_extract(F.trim(text), r"(?s)^```[^\n]*\n(.*)\n\s*```\s*$", 1)
    plain = F.when(F.trim(text).startswith("```") & (body != ""), F.trim(body)).otherwise(F.trim(text))
    return F.when(F.lower(plain).startswith("json"), F.trim(F.substring(plain, 5, 1 << 30))).otherwise(plain)


def json_payload(text: Column) -> Column:
    """JSON text inside a model response: whole text, else the outermost [...], else the outermost {...}."""
    plain = unfence(text)
    whole = F.when(F.try_parse_json(plain).isNotNull(), plain)
    array = F.regexp_extract(plain, r"(?s)\[.*\]", 0)
    block = F.regexp_extract(plain, r"(?s)\{.*\}", 0)
    return F.coalesce(
        whole,
        F.when((array != "") & F.try_parse_json(array).isNotNull(), array),
        F.when((array == "") & (block != "") & F.try_parse_json(block).isNotNull(), block),
    )


_RAW_ITEM = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "description", "root_cause", "confidence", "evidence",
            "affected_nodes", "affected_links", "recommended_actions",
        )
    ]
)


def _as_list(raw: Column) -> Column:
    """A JSON list as text items; a scalar becomes a one-item list; null becomes empty."""
    return F.coalesce(
        F.when(raw.startswith("["), F.from_json(raw, T.ArrayType(T.StringType()))),
        F.when(raw.isNotNull(), F.array(raw)),
        F.array().cast("array<string>"),
    )


def hypothesis_items(text: Column) -> Column:
    """Array of hypothesis structs parsed from a stored response; empty when nothing usable is inside."""
    payload = json_payload(text)
    wrapped = F.get_json_object(payload, "$.hypotheses")
    listed = (
        F.when(payload.startswith("["), payload)
        .when(wrapped.startswith("["), wrapped)
        .when(payload.startswith("{"), F.concat(F.lit("["), payload, F.lit("]")))
    )
    items = F.filter(F.from_json(listed, T.ArrayType(T.StringType())), lambda s: s.startswith("{"))

    def build(s: Column) -> Column:
        raw = F.from_json(s, _RAW_ITEM)
        number = raw["confidence"].try_cast("double")
        confidence = F.when(raw["confidence"].isNull(), F.lit(0.5)).otherwise(number)
        return F.struct(
            F.coalesce(raw["description"], F.lit("Unknown network issue")).alias("description"),
            F.coalesce(raw["root_cause"], F.lit("unknown")).alias("root_cause"),
            clamp(confidence, 0.0, 1.0).alias("confidence"),
            number.isNull().__and__(raw["confidence"].isNotNull()).alias("bad"),
            _as_list(raw["evidence"]).alias("evidence"),
            _as_list(raw["affected_nodes"]).alias("affected_nodes"),
            _as_list(raw["affected_links"]).alias("affected_links"),
            _as_list(raw["recommended_actions"]).alias("recommended_actions"),
        )

    return F.coalesce(F.filter(F.transform(items, build), lambda h: ~h["bad"]), F.array())


def normal_position(raw: Column) -> Column:
    low = F.lower(raw)
    return F.when(low.isin("support", "oppose", "conditional"), low).otherwise("conditional")


def normal_verdict(raw: Column) -> Column:
    low = F.lower(raw)
    return F.when(low.isin("approve", "reject", "modify"), low).otherwise("modify")


def joined_argument(arguments: Column) -> Column:
    text = F.trim(F.array_join(arguments, " "))
    return F.when(F.coalesce(F.size(arguments), F.lit(0)) > 0, text).otherwise("No argument provided.")
