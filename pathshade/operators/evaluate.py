"""Monte Carlo evaluation of picked sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pathshade.functions.stats import summary
from pathshade.operators.objectives import Original


def evaluate(objective: Original, picked: Sequence[int], alpha: float = 0.05) -> DataFrame:
    """Statistics of the agents' best scores."""
    return summary(objective.agent_values(picked), "value", alpha)


def evaluate_difference(objective: Original, a: Sequence[int], b: Sequence[int], alpha: float = 0.05) -> DataFrame:
    """Statistics of the paired differences between two sets on the same agents."""
    left = objective.agent_values(a).withColumnRenamed("value", "x")
    right = objective.agent_values(b).withColumnRenamed("value", "y")
    return summary(left.join(right, "agent").select((F.col("x") - F.col("y")).alias("value")), "value", alpha)
