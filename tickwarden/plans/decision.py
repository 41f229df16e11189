"""Hypotheses to ranked, verified actions in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwarden.operators import safety as S
from tickwarden.operators import whatif as W
from tickwarden.operators.causal import CausalGraph
from tickwarden.operators.topology import customer_impact
from tickwarden.session import cut


def decide(
    hypotheses: DataFrame, state: DataFrame, nodes: DataFrame, links: DataFrame, graph: CausalGraph,
    history: DataFrame | None = None, constraints: dict | None = None,
) -> DataFrame:
    """One row per candidate action with utility, predicted risk, verdict, policy and rank per incident.

    Every candidate is verified; the safest useful one is rank 1. `hypotheses`: incident_id, hypothesis_id and the
    hypothesis columns.
    """
    impact = customer_impact(W.affected_entities(hypotheses), nodes, "hypothesis_id")
    actions = cut(W.utility(W.candidates(hypotheses, links), impact))
    predicted = W.effect(actions, state, graph)
    given = S.SafetyInput(actions, state, predicted, nodes, links, history)
    verdicts = S.verify(given, constraints).select("action_id", "is_safe", "violations", "proof")
    rows = (
        actions.join(W.counterfactual_risk(predicted), "action_id", "left")
        .join(W.projection_risk(actions, state), "action_id", "left")
        .join(verdicts, "action_id")
    )
    risk = W.combined_risk(
        F.col("risk_level"), F.coalesce("projection_risk", "risk_level"), F.coalesce("projection_safe", F.lit(True)), F.col("causal_risk")
    )
    rows = W.policy(rows.withColumn("risk_level", risk))
    rows = rows.withColumn("needs_review", W.needs_review(F.col("action_type"), F.col("risk_level"), F.col("confidence")))
    return W.rank_actions(rows)
