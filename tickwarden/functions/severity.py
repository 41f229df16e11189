"""Bands: severity scales, ranks, status and utilisation labels (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickwarden.schemas import LATENCY_FACTOR


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def ladder(x: Column, steps: list[tuple[float, str]], otherwise: str | None) -> Column:
    """First label whose lower bound `x` reaches, from the highest bound down."""
    expr = None
    for bound, label in steps:
        test = x >= F.lit(float(bound))
        expr = F.when(test, label) if expr is None else expr.when(test, label)
    return expr.otherwise(F.lit(otherwise))


def observed_severity(ratio: Column) -> Column:
    return ladder(ratio, [(1.3, "critical"), (1.1, "high")], "medium")


def predicted_severity(ratio: Column) -> Column:
    return ladder(ratio, [(1.25, "critical"), (1.1, "high"), (1.0, "medium")], "low")


def sigma_severity(sigmas: Column) -> Column:
    return ladder(sigmas, [(5.0, "critical"), (4.0, "high")], "medium")


def isolation_severity(score: Column) -> Column:
    return ladder(-score, [(0.3, "critical"), (0.2, "high"), (0.1, "medium")], "low")


def severity_rank(severity: Column) -> Column:
    return (
        F.when(severity == "critical", 3).when(severity == "high", 2).when(severity == "medium", 1).otherwise(0)
    )


def report_value(x: Column) -> Column:
    return F.round(x, 6)


def report_confidence(x: Column) -> Column:
    return clamp(F.round(x, 4), 0.0, 0.99)


def node_status(cpu: Column, temperature: Column, memory: Column) -> Column:
    return (
        F.when((cpu >= 95) | (temperature >= 82), "critical")
        .when((cpu >= 75) | (temperature >= 70) | (memory >= 90), "degraded")
        .otherwise("healthy")
    )


def link_status(util: Column, loss: Column, latency: Column, baseline: Column) -> Column:
    return (
        F.when((util == 0) & (loss >= 99), "down")
        .when((util >= 90) | (loss >= 5), "congested")
        .when((util >= 70) | (loss >= 1) | (latency > baseline * LATENCY_FACTOR), "degraded")
        .otherwise("healthy")
    )


def utilization_band(util: Column) -> Column:
    return F.when(util.isNull(), "unknown").otherwise(
        ladder(util, [(85, "hot"), (70, "busy"), (50, "warm")], "calm")
    )
