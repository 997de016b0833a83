"""Options of a chunking run."""

from __future__ import annotations

from dataclasses import dataclass, replace

MODES = ("conditional", "always", "none")


@dataclass(frozen=True)
class ChunkOptions:
    """Bounds in tokens, overlap in sentences. ``target`` 0 or None means unset."""

    min_tokens: int = 64
    max_tokens: int = 512
    target_tokens: int | None = 400
    overlap_sentences: int = 2
    strict: bool = False
    breadcrumb_mode: str = "conditional"
    #: Ranks of a byte-pair vocabulary; None counts by the length heuristic.
    ranks_file: str | None = None

    def __post_init__(self) -> None:
        if self.breadcrumb_mode not in MODES:
            raise ValueError(f"breadcrumb_mode must be one of {MODES}")

    def with_(self, **changes) -> ChunkOptions:
        return replace(self, **changes)

    # The target that each stage falls back on differs; all three rules are kept.
    @property
    def pack_target(self) -> float:
        return self.target_tokens or self.max_tokens * 0.8

    @property
    def source_target(self) -> int:
        return self.target_tokens or int(self.max_tokens * 0.8)

    @property
    def stats_target(self) -> int:
        return self.target_tokens or (self.min_tokens + self.max_tokens) // 2


DEFAULTS = ChunkOptions()
