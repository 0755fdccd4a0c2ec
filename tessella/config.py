"""Run configuration: frozen, validated, with a stable hash for caches."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

AGGREGATIONS = ("vlad", "gem", "gap", "gmp", "cls")
MATCHERS = ("sim_map", "cosine_pool", "mutual_nn")
OFFSETS = ("slide_ncc", "sim_map")
VOTES = ("sum", "revisit_weighted_borda_image")


@dataclass(frozen=True)
class PipelineConfig:
    aggregation: str = "vlad"
    num_clusters: int = 8
    soft_assignment: bool = False
    gem_p: float = 3.0
    top_k_vals: tuple[int, ...] = tuple(range(1, 21))
    coarse_top_k: int = 10
    rerank: bool = True
    matcher: str = "sim_map"
    alpha: float = 0.5
    top_m: int = 32
    temperature: float = 15.0
    offset: str = "slide_ncc"
    vote: str = "sum"
    segment_top_k: int = 100
    neighbours: int = 4
    order: int = 1
    centroid_frequencies: int = 4
    centroid_weight: float = 0.0
    context_frequencies: int = 2
    context_weight: float = 0.0
    sub_sample_db: int = 1
    sub_sample_queries: int = 1
    thresholds: tuple[int, ...] = (16, 32, 64)
    seed: int = 42
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        for name, allowed in (("aggregation", AGGREGATIONS), ("matcher", MATCHERS), ("offset", OFFSETS), ("vote", VOTES)):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name}: {getattr(self, name)!r} is none of {', '.join(allowed)}")
        for name in ("num_clusters", "coarse_top_k", "top_m", "segment_top_k", "neighbours", "order", "centroid_frequencies", "context_frequencies", "sub_sample_db", "sub_sample_queries"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")

    @property
    def width(self) -> int:
        """Results kept of each query."""
        return max(max(self.top_k_vals), self.coarse_top_k)

    def key(self) -> str:
        """Twelve digits that change with any setting, so no cache outlives its parameters."""
        return hashlib.sha1(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:12]
