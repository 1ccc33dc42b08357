"""Settings of the matching flow."""

from __future__ import annotations

from dataclasses import dataclass, field

from .functions.tokens import RANK_PROMPT


@dataclass(frozen=True)
class Columns:
    """Names of the three columns a noisy table must have."""

    # The names tables are written with unless told otherwise.
    noisy: str = "malformed_first_line"
    canonical: str = "first_line"
    steps: str = "malformed_first_line_malform_steps"


@dataclass(frozen=True)
class MatchConfig:
    """Where rows come from and how they are split, mined, scored and picked."""

    source_table: str | None = None
    source_parquet: str | None = None
    columns: Columns = field(default_factory=Columns)

    steps_filter: str = "legacy_one_comma"
    steps_min: int = 1
    steps_max: int = 1
    max_rows: int | None = None

    max_neighbors: int = 10
    per_neighbor: int = 5
    per_row: int = 15

    test_size: float = 0.1
    split_seed: int = 42

    prompt: str = RANK_PROMPT
    max_input_length: int = 128

    shortlist_k: int = 64
    eval_max_rows: int | None = None
    pick_policy: str = "encoder_margin_blend"
    blend_weight: float = 2.0
    ranker_pool: int = 24
    inject_truth: bool = True

    predictions_table: str | None = None
    artifact_dir: str | None = None
