"""Model configuration (V14) and engine limits."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass


@dataclass(frozen=True)
class ModelConfig:
    """Training parameters of a bag-of-words projection model.

    Defaults equal the reference's defaults. ``projection_dropout`` is kept
    for the saved config but, as in the reference, training never reads it;
    embedding takes its own ``dropout_rate`` argument (default 0.0).
    """

    embedding_dim: int = 256
    min_token_frequency: int = 3
    max_vocabulary_size: int = 50000
    random_seed: int = 42
    use_ngrams: bool = True
    use_orthogonal_init: bool = True
    projection_dropout: float = 0.1

    def __post_init__(self):
        # the reference's builder clamps dropout to [0, 0.9]
        object.__setattr__(self, "projection_dropout",
                           clamp_dropout(self.projection_dropout))
        if self.embedding_dim < 1:
            raise ValueError("embedding_dim must be positive")
        if self.max_vocabulary_size < 0 or self.min_token_frequency < 0:
            raise ValueError("vocabulary limits must be non-negative")

    def replace(self, **changes) -> "ModelConfig":
        return dataclasses.replace(self, **changes)

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> "ModelConfig":
        names = {f.name for f in dataclasses.fields(cls)}
        return cls(**{k: v for k, v in d.items() if k in names})


def clamp_dropout(rate: float) -> float:
    return float(min(max(rate, 0.0), 0.9))


@dataclass(frozen=True)
class Limits:
    """Size guards for everything that is shipped whole to executors.

    ``broadcast_bytes`` bounds a block of a model, of queries or of centroids;
    more than that goes out in several blocks, which changes no answer.
    """

    broadcast_bytes: int = 512 * 1024 * 1024
    # rows of (term, weight) handled per numpy chunk in the dense projection
    projection_chunk: int = 16384


DEFAULT_LIMITS = Limits()
