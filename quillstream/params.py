"""Parameters that define the semantics, with overrides from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Params:
    # Thresholds and windows that results depend on.
    match_score_min: float = 78.0
    pointer_bonus: float = 8.0
    band_width: float = 4.0
    window_forward: int = 12
    window_back: int = 8
    confirm_after: int = 3
    streak_min: int = 4
    streak_tail: int = 8
    block_hit_ratio: float = 0.5
    relocation_score_min: float = 0.6
    jump_confirm: int = 2
    gram: int = 3
    diagonal_width: int = 3
    common_word_postings: int = 3000
    min_run: int = 2
    top_hits: int = 5
    detect_min_tokens: int = 4
    detect_max_tokens: int = 16
    detect_score_min: float = 0.65
    detect_margin: float = 0.2
    vote_floor: float = 0.4
    votes_needed: int = 3
    votes_lead: int = 2
    votes_kept: int = 6
    stop_gram_df: int = 60
    min_grams: int = 2
    pair_window: int = 10
    pair_threshold: float = 72.0
    id_gram: int = 4
    id_match_max: float = 0.45
    id_jump_margin: float = 0.25
    id_band_back: int = 3
    id_band_forward: int = 4
    id_detect_min: int = 6
    id_detect_score: float = 0.45
    id_detect_margin: float = 0.18
    id_votes_needed: int = 2
    id_votes_kept: int = 5
    agreement_min: float = 0.75
    template_max: float = 0.30
    sample_rate: int = 16000
    frame: int = 512
    speech_on: float = 0.5
    speech_off: float = 0.35
    segment_max_sec: float = 5.0
    overlap_sec: float = 0.5
    silence_cut_sec: float = 0.7
    quiet_lookback_sec: float = 1.5
    sessions_max: int = 3
    sessions_per_ip: int = 2
    session_minutes: int = 90
    idle_seconds: int = 120
    bytes_per_second: int = 32000
    rate_factor: float = 1.1
    rate_burst_sec: float = 3.0
    retention_days: int = 30

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "QUILLSTREAM_") -> Params:
        """Defaults, overridden by ``QUILLSTREAM_<NAME>``; unknown names are ignored."""
        env = os.environ if env is None else env
        given = {f.name: type(f.default)(env[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in env}
        return replace(cls(), **given)


DEFAULT = Params()

# The opening formulas that may precede a passage, by kind.
OPENINGS = (
    ("istiadha", ("اعوذ", "بالله", "من", "الشيطان", "الرجيم")),
    ("basmalah", ("بسم", "الله", "الرحمن", "الرحيم")),
)
