"""Chunks of Markdown and plain-text documents, on PySpark."""

from .operators.embed import add_embed_text
from .operators.guardrails import validate
from .operators.metadata import attach_metadata
from .operators.normalize import normalize_chunks
from .operators.overlap import add_overlap
from .operators.pack import pack_arrays
from .operators.parse import parsed, split_blocks
from .operators.source import source_metrics
from .operators.stats import compute_stats
from .plans.options import DEFAULTS, ChunkOptions
from .plans.pipeline import add_error, analyze_only, chunks, flow, full, has_errors, stages

chunk_markdown = full

__all__ = [
    "DEFAULTS", "ChunkOptions", "add_embed_text", "add_error", "add_overlap", "analyze_only", "attach_metadata", "chunk_markdown", "chunks", "compute_stats", "flow", "full", "has_errors",
    "normalize_chunks", "pack_arrays", "parsed", "source_metrics", "split_blocks", "stages", "validate",
]
