"""Parameters of the jobs."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    # segmentation, in code points
    max_content_length: int = 2000
    min_content_length: int = 500
    image_context_length: int = 200
    image_extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "gif", "bmp", "webp")
    # item names
    item_name_chunks: int = 3
    item_name_chars: int = 2500
    high_score: float = 0.7
    mid_score: float = 0.6
    max_options: int = 3
    score_gap: float = 0.15
    # vectors and search
    embedding_batch: int = 8
    embedding_dim: int = 1024
    leg_limit: int = 5
    fused_limit: int = 5
    leg_weights: tuple[float, float] = (0.5, 0.5)
    # fusion, reranking, prompt
    rrf_k: int = 60
    rrf_max: int = 10
    rerank_max: int = 10
    rerank_min: int = 3
    rerank_gap: float = 0.5
    prompt_chars: int = 12000
    # history and rates
    history_for_model: int = 10
    history_for_view: int = 50
    requests_per_minute: int = 15
    total_steps: dict[str, int] = field(default_factory=lambda: {"pdf": 8, "md": 7})

    def __post_init__(self) -> None:
        if not 0 < self.min_content_length < self.max_content_length:
            raise ValueError("0 < min_content_length < max_content_length must hold")


DEFAULT = Config()
