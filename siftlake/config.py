"""Options of deduplication, with their defaults and checks."""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass, field, fields, replace
from enum import Enum

from .errors import InvalidOption


class Mode(Enum):
    EXACT = "exact"
    SEMANTIC = "semantic"


class Normalization(Enum):
    NONE = "none"
    WHITESPACE = "whitespace"
    ASCII = "ascii"
    UNICODE = "unicode"


#: What models of each family want before a text.
INSTRUCTIONS = {"minilm": "", "bge": "Represent this sentence for searching relevant passages: ", "e5": "passage: ", "nomic": "search_document: "}
THRESHOLDS = (0.80, 0.85, 0.90, 0.92, 0.95, 0.98)
LATENCY_BUCKETS = (0.5, 1, 2.5, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000)


@dataclass(frozen=True)
class DedupConfig:
    mode: Mode = Mode.EXACT
    normalization: Normalization = Normalization.NONE
    normalization_max_bytes: int = 1 << 20
    text_column: str = "text"
    text_columns: tuple[str, ...] = ()
    separator: str = " "
    order_column: str = "doc_id"
    key_prefix: str = ""
    keep_first: bool = True  # False keeps the last of equal values: an extension
    batch_size: int = 100
    semantic_threshold: float = 0.85
    semantic_model: str = "minilm"
    semantic_max_text_bytes: int = 8192
    embedding_column: str = ""  # vectors that are there already, instead of an embedder
    search_floor: float | None = None  # the least cosine that candidates are looked for at; unset: what the thresholds need
    search_k: int = 50
    reranker: bool = False
    reranker_top_k: int = 100
    reranker_threshold: float = 0.8
    rnn: bool = False
    rnn_k: int = 0
    margin: bool = False
    margin_threshold: float = 0.05
    judge: bool = False
    judge_threshold: float = 0.75
    judge_min_score: int = 5
    default_ttl_seconds: int = 0
    enable_gc: bool = True
    lru_update_interval_seconds: int = 3600
    max_store_bytes: int = 0
    eviction_target_ratio: float = 0.8

    def __post_init__(self) -> None:
        for name in ("semantic_threshold", "reranker_threshold", "judge_threshold", "margin_threshold", "eviction_target_ratio"):
            if not 0 <= getattr(self, name) <= 1:
                raise InvalidOption(f"{name} must be from 0 to 1")
        for name in ("batch_size", "search_k", "reranker_top_k", "semantic_max_text_bytes"):
            if getattr(self, name) < 1:
                raise InvalidOption(f"{name} must be at least 1")
        for name in ("rnn_k", "default_ttl_seconds", "lru_update_interval_seconds", "max_store_bytes", "normalization_max_bytes"):
            if getattr(self, name) < 0:
                raise InvalidOption(f"{name} can't be negative")
        if self.semantic_model not in INSTRUCTIONS:
            raise InvalidOption(f"semantic_model must be one of {', '.join(INSTRUCTIONS)}")
        if self.mode is Mode.EXACT and (self.reranker or self.judge or self.margin or self.rnn):
            raise InvalidOption("reranker, judge, margin and rnn are options of semantic mode")

    @classmethod
    def of(cls, base: DedupConfig | None = None, **options) -> DedupConfig:
        """From keywords; an unknown one is an error."""
        unknown = set(options) - {f.name for f in fields(cls)}
        if unknown:
            raise InvalidOption(f"unknown options: {', '.join(sorted(unknown))}")
        return replace(base or cls(), **options)

    def digest(self) -> str:
        """Eight hex digits for cache paths; every option counts."""
        text = ";".join(f"{k}={v.value if isinstance(v, Enum) else v}" for k, v in sorted(asdict(self).items()))
        return hashlib.sha256(text.encode()).hexdigest()[:8]


@dataclass(frozen=True)
class CrossDatasetConfig:
    """Contamination and comparison across datasets; the threshold stands in for the one of `dedup`, and gates are off."""

    dedup: DedupConfig = field(default_factory=DedupConfig)
    contamination_threshold: float = 0.95

    def __post_init__(self) -> None:
        if not 0 <= self.contamination_threshold <= 1:
            raise InvalidOption("contamination_threshold must be from 0 to 1")


@dataclass(frozen=True)
class CacheConfig:
    directory: str
    key: str | None = None
    overwrite: bool = False
