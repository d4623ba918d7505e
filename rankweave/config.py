"""Settings of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field

ENCODER_ALIASES = {"sentence-transformers": "minilm", "all-minilm-l6-v2": "minilm", "auto": "minilm"}


@dataclass(frozen=True)
class RetrievalConfig:
    semantic_encoder: str = "hashing"
    lexical_candidates: int = 100
    semantic_candidates: int = 100
    fusion_candidates: int = 200
    default_top_k: int = 10
    rrf_k: int = 60
    fusion_method: str = "rrf"
    lexical_weight: float = 0.45
    semantic_weight: float = 0.55
    k1: float = 1.5
    b: float = 0.75
    field_weights: dict[str, float] = field(default_factory=lambda: {
        "function_name": 3.0, "class_name": 2.6, "docstring": 2.0, "imports": 1.5, "file_path": 1.4, "code": 1.0})
    enable_reranking: bool = False
    rerank_alpha: float = 0.05
    rerank_features: tuple[str, ...] = ("phrase", "identifier", "intent", "version")
    hash_dimensions: int = 384

    @property
    def encoder(self) -> str:
        name = self.semantic_encoder.lower()
        return ENCODER_ALIASES.get(name, name)

    @property
    def alpha(self) -> float:
        """The rerank weight, held between 0 and 1."""
        return max(0.0, min(1.0, float(self.rerank_alpha)))
