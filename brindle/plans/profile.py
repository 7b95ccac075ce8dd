"""Component profiles: statistics, example occurrences on the prevailing tail, example tokens
(L2, L3, W2, W5, J5-J8, A6-A9, A63). Two passes over the scores, joined on the component."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.statistics import component_statistics, kurtosis_ranks
from ..operators.windows import competition_rank, top_per_key


def occurrences(scores: DataFrame, stats: DataFrame, k: int, *, row: str = "row_id", component: str = "component", value: str = "score") -> DataFrame:
    """The k strongest rows of each component on its tail; ties go to the later row. The tail filter comes
    before the ranking, and each task keeps k rows per component before the shuffle."""
    tails = F.broadcast(stats.select(component, "tail"))  # a row per component
    on_tail = scores.join(tails, component).where(F.signum(value) == F.col("tail"))
    return top_per_key(on_tail, k, [component], [F.desc(F.abs(value)), F.desc(row)])


def with_ranks(found: DataFrame, scores: DataFrame, *, row: str = "row_id", component: str = "component", value: str = "score") -> DataFrame:
    """Competition ranks of the retained pairs among all components of their rows."""
    rows = scores.join(found.select(row).distinct(), row, "left_semi").select(row, component, competition_rank(F.abs(value), row).alias("absolute_score_rank"))
    return found.join(rows, [row, component])


def example_tokens(found: DataFrame, tokens: DataFrame, *, row: str = "row_id", component: str = "component", token: str = "token") -> DataFrame:
    """How often each token stands among a component's occurrences, most frequent first, then by text."""
    counts = found.join(tokens.select(row, token), row).groupBy(component, token).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(component).orderBy(F.desc("n"), token)).cast("long"))


def profile(scores: DataFrame, k: int, tokens: DataFrame | None = None) -> dict[str, DataFrame]:
    """statistics, occurrences and, with tokens, example_tokens."""
    stats = kurtosis_ranks(component_statistics(scores))
    found = with_ranks(occurrences(scores, stats, k), scores)
    out = {"statistics": stats, "occurrences": found}
    if tokens is not None:
        out["example_tokens"] = example_tokens(found, tokens)
    return out
