"""All settings, passed explicitly to the operators that use them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    max_entity_token_distance: int = 10
    max_path_len: int = 5
    # fixed values: parts of speech that count as content on a dependency path
    path_content_pos: tuple[str, ...] = ("VERB", "NOUN", "PROPN", "ADP", "PART", "AUX")
    min_path_support: int = 1
    type_signature_blocking: bool = True
    threshold_min: float = 0.30
    threshold_max: float = 0.75
    recluster_every: int = 25
    type_smoothing_max_alpha: float = 0.0
    max_block_size: int = 800
    threshold_ema_beta: float = 0.5
    min_block_for_gap: int = 3
    label_carryover_jaccard: float = 0.5
    conf_cohesion_weight: float = 0.5
    calib_bins: int = 10
    calib_min_evidence: int = 20
    subsumption_min_containment: float = 0.6
    compact_every: int = 200
    similarity_eps: float = 0.4
    similarity_terms: int = 50
    similarity_without_context: bool = True  # entities without any context word count as similar to each other
    skip_negated: bool = True
    negation_penalty: float = 0.4
    min_triples_for_eval: int = 20
    kg_test_ratio: float = 0.2
    conf_ner: float = 0.9
    conf_noun_chunk: float = 0.6
    conf_pair: float = 0.7
    conf_similarity: float = 0.25
    al_shrinkage: float = 10.0
    al_human_weight: float = 1.0
    al_seed_weight: float = 0.3
    al_refit_epochs: int = 12
    al_batch: int = 5
    kg_excluded_sources: tuple[str, ...] = ("distributional_similarity",)
    kg_model: str = "rotate"  # or "complex"
    kg_dim: int = 50
    kg_epochs: int = 50
    persist: bool = True


DEFAULT = Config()
NO_RELATION = "NO_RELATION"
RELATED_TO = "RELATED_TO"
SIMILAR_TO = "SIMILAR_TO"
ARROW = "→"
