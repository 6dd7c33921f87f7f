"""Named settings of a whole trace, and the plan that runs one on an alignment."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.alphabets import letters_of
from ..operators import agglomerate, columns, distance, trace


@dataclass(frozen=True)
class Settings:
    """Options of a trace; what a preset does not name keeps its default."""

    position: str = "single"
    metric: str = "identity"
    gap_correction: float | None = None
    tree_method: str = "upgma_first"
    ranks: tuple[int, ...] | None = None
    distance_model: str = "identity"
    #: Score table of the models that need one: a row and a column for each code.
    scores: tuple[tuple[float, ...], ...] | None = None
    polymer: str = "Protein"

    def __post_init__(self) -> None:
        if self.position not in ("single", "pair"):
            raise ValueError("position must be 'single' or 'pair'")
        metrics.check(self.metric, self.pos_size)
        letters_of(self.polymer)
        if self.distance_model not in ("identity", "substitution", "trace"):
            raise ValueError(f"no distance model {self.distance_model!r}: identity, substitution or trace")
        if self.distance_model != "identity" and self.scores is None:
            raise ValueError(f"the model {self.distance_model!r} needs a score table")

    @property
    def pos_size(self) -> int:
        return 1 if self.position == "single" else 2


PRESETS = {
    "integer": Settings("single", "identity"),
    "entropy": Settings("single", "plain_entropy", 0.6),
    "mutual-information": Settings("pair", "filtered_average_product_corrected_mutual_information"),
    "transitions": Settings("pair", "mismatch_diversity"),
}


def preset(name: str, **changes) -> Settings:
    if name not in PRESETS:
        raise ValueError(f"no preset {name!r}; there are {sorted(PRESETS)}")
    return replace(PRESETS[name], **changes)


def run(packed: DataFrame, gap: int, settings: Settings, distances: DataFrame | None = None) -> DataFrame:
    """Distances -> tree -> ranks -> node scores -> positions with score, rank and coverage.

    ``packed`` is one alignment (seq_idx, codes).  Neither its distances nor its counts come to the driver; each row
    takes part in the nodes above it by counts that are rolled up the tree.
    """
    table = [list(r) for r in settings.scores] if settings.scores else None
    if distances is None and settings.distance_model == "identity":
        nodes = agglomerate.identity_tree(packed, settings.tree_method)
    else:
        pairs = distance.distances(packed, settings.distance_model, table, gap) if distances is None else distances
        nodes = agglomerate.agglomerated(pairs, packed, settings.tree_method)
    gaps = None
    if settings.gap_correction is not None and settings.pos_size == 1:
        gaps = columns.gap_share(columns.residues(packed), gap).select("pos", "gap_fraction")
    elif settings.gap_correction is not None:
        gaps = columns.pair_gap_share(packed, gap)
    ranks = list(settings.ranks) if settings.ranks else None
    return trace.tree_trace(packed, nodes, settings.metric, settings.pos_size, ranks, gaps, settings.gap_correction)
