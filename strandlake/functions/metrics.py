"""Column builders of the scores of a position or a pair of positions in a group."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: tan(pi/2) in double precision: what x/0 counts as.
VERTICAL = math.tan(math.pi / 2)

SINGLE = ("identity", "plain_entropy")
PAIR = (
    "identity", "plain_entropy", "mutual_information", "normalized_mutual_information",
    "average_product_corrected_mutual_information", "filtered_average_product_corrected_mutual_information",
    "match_count", "mismatch_count", "match_mismatch_count_ratio", "match_mismatch_count_angle",
    "match_entropy", "mismatch_entropy", "match_mismatch_entropy_ratio", "match_mismatch_entropy_angle",
    "match_diversity", "mismatch_diversity", "match_mismatch_diversity_ratio", "match_mismatch_diversity_angle",
    "match_diversity_mismatch_entropy_ratio", "match_diversity_mismatch_entropy_angle",
)
#: Higher is better for these; for all others lower is better.
MAXIMAL = {
    "mutual_information", "normalized_mutual_information",
    "average_product_corrected_mutual_information", "filtered_average_product_corrected_mutual_information",
    "match_count", "match_entropy", "match_diversity",
}


def direction(metric: str) -> str:
    return "max" if metric in MAXIMAL else "min"


def check(metric: str, pos_size: int) -> None:
    allowed = {1: SINGLE, 2: PAIR}.get(pos_size, ())
    if metric not in allowed:
        raise ValueError(f"{metric!r} does not score {pos_size} position(s)")


def entropy(cnt: Column, depth: Column) -> Column:
    """Aggregate: entropy (natural logarithm) of counts over a depth; 0 for no counts."""
    f = cnt / depth
    return F.coalesce(-F.sum(f * F.ln(f)), F.lit(0.0))


def identity(code: Column) -> Column:
    """Aggregate: 1 where more than one character is seen, else 0."""
    return F.when(F.count_distinct(code) > 1, 1).otherwise(0)


def ratio(mismatch: Column, match: Column) -> Column:
    """mismatch / match; tan(pi/2) for x/0 and 0 for 0/0."""
    return F.when(match != 0, mismatch / F.nullif(match, F.lit(0.0))).when(mismatch != 0, F.lit(VERTICAL)).otherwise(0.0)


def angle(value: Column) -> Column:
    return F.atan(value)


def normalized(mi: Column, h_i: Column, h_j: Column) -> Column:
    """Mutual information over the mean of both entropies; 1 if both are 0."""
    return F.when((h_i == 0) & (h_j == 0), 1.0).otherwise(mi / F.nullif((h_i + h_j) / 2, F.lit(0.0)))


#: From columns m_cnt, mm_cnt, m_ent, mm_ent (counts and entropies of matches and mismatches).
TRANSITION: dict[str, Callable[[], Column]] = {
    "match_count": lambda: F.col("m_cnt").cast("double"),
    "mismatch_count": lambda: F.col("mm_cnt").cast("double"),
    "match_mismatch_count_ratio": lambda: ratio(F.col("mm_cnt").cast("double"), F.col("m_cnt").cast("double")),
    "match_mismatch_count_angle": lambda: angle(TRANSITION["match_mismatch_count_ratio"]()),
    "match_entropy": lambda: F.col("m_ent"),
    "mismatch_entropy": lambda: F.col("mm_ent"),
    "match_mismatch_entropy_ratio": lambda: ratio(F.col("mm_ent"), F.col("m_ent")),
    "match_mismatch_entropy_angle": lambda: angle(TRANSITION["match_mismatch_entropy_ratio"]()),
    "match_diversity": lambda: F.exp("m_ent"),
    "mismatch_diversity": lambda: F.exp("mm_ent"),
    "match_mismatch_diversity_ratio": lambda: ratio(F.exp("mm_ent"), F.exp("m_ent")),
    "match_mismatch_diversity_angle": lambda: angle(TRANSITION["match_mismatch_diversity_ratio"]()),
    "match_diversity_mismatch_entropy_ratio": lambda: ratio(F.col("mm_ent"), F.exp("m_ent")),
    "match_diversity_mismatch_entropy_angle": lambda: angle(TRANSITION["match_diversity_mismatch_entropy_ratio"]()),
}
