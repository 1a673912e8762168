"""Frozen operator parameters (driver-side plain values, never data)."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical results.
#   chunk size 500 words, overlap 50 words
#   hash embedding dimension 256, default model dimension 768
#   top-k default 3; hybrid over-fetch 2k, weights content 0.7 / filename 0.3
#   vector score = cosine + 1.0
#   compression defaults: history 2000, chunk 1200, context 5000 characters
#   benchmark compression: history 800, chunk 160, context 400 characters
#   truncation marker "..."
# ---------------------------------------------------------------------------
DEFAULT_CHUNK_SIZE = 500
DEFAULT_CHUNK_OVERLAP = 50
HASH_DIM = 256
DEFAULT_MODEL_DIM = 768
DEFAULT_K = 3
HYBRID_CONTENT_WEIGHT = 0.7
HYBRID_FILENAME_WEIGHT = 0.3
VECTOR_SCORE_OFFSET = 1.0
TRUNCATION_MARKER = "..."


@dataclass(frozen=True)
class ChunkConfig:
    size: int = DEFAULT_CHUNK_SIZE
    overlap: int = DEFAULT_CHUNK_OVERLAP

    def __post_init__(self) -> None:
        if self.size <= 0:
            raise ValueError("chunk size must be positive")
        if self.overlap < 0 or self.overlap >= self.size:
            # The loop form errors (step 0) or silently yields nothing; reject up front.
            raise ValueError(
                f"overlap ({self.overlap}) must be >= 0 and smaller than chunk size ({self.size})"
            )

    @property
    def step(self) -> int:
        return self.size - self.overlap


@dataclass(frozen=True)
class CompressionConfig:
    enabled: bool = False
    max_history_chars: int = 2000
    max_chunk_chars: int = 1200
    max_context_chars: int = 5000


# Compression settings used by the offline evaluation.
EVAL_COMPRESSION = CompressionConfig(
    enabled=True, max_history_chars=800, max_chunk_chars=160, max_context_chars=400
)


@dataclass(frozen=True)
class Bm25Config:
    k1: float = 1.2
    b: float = 0.75


@dataclass(frozen=True)
class SearchConfig:
    k: int = DEFAULT_K
    content_weight: float = HYBRID_CONTENT_WEIGHT
    filename_weight: float = HYBRID_FILENAME_WEIGHT
    score_offset: float = VECTOR_SCORE_OFFSET
    # Largest query block broadcast to the corpus scan, in bytes of float64 vectors.
    max_block_bytes: int = 64 * 1024 * 1024
