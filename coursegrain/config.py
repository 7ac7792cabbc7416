"""Tunables of the library."""

from __future__ import annotations

from dataclasses import dataclass


# Results depend on them.
@dataclass(frozen=True)
class Tunables:
    token_counter: str = "words"  # or a file of the tokenizers library
    target_tokens: int = 600
    min_tokens: int = 120
    max_tokens: int = 900
    overlap_ratio: float = 0.15
    min_tokens_for_generation: int = 150
    slide_median_tokens: int = 200
    furniture_ratio: float = 0.60
    furniture_min_pages: int = 5
    furniture_max_chars: int = 120
    scanned_chars_per_page: int = 100
    top_k: int = 5
    resolver_top_k: int = 10
    fuzzy_threshold: float = 85.0
    weakness_cap: float = 2.0
    weak_accuracy: float = 0.6
    mature_stability: float = 21.0
    desired_retention: float = 0.9
    length_bias_ratio: float = 1.5
    option_cosine: float = 0.90
    stem_cosine: float = 0.92
    lookback_quizzes: int = 3
    min_distinct_paths: int = 3
    singleton_collapse: float = 0.8
    chunks_per_cluster: int = 6
    seconds_per_concept: int = 25
    evidence_word_length: int = 5
    grounded_overlap: float = 0.30
    due_limit: int = 50
    coverage_bar: float = 0.90
    recall_bar: float = 0.80


DEFAULTS = Tunables()
