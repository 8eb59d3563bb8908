"""Documents to chunks, and what is done with chunks, on Spark; names are loaded when they are used."""

from importlib import import_module

_HOMES = {
    "kerf.facade": ("Chunker", "build_chunk_graph", "chunk", "chunk_diff", "chunk_directory", "chunk_file", "hierarchical_chunk", "stable_chunk_id"),
    "kerf.plans.options": ("Options",),
    "kerf.operators.store": ("Store",),
    "kerf.operators.dedup": ("dedup",),
    "kerf.operators.semantic": ("semantic_chunks",),
    "kerf.operators.analytics": ("budget_select", "chunk_stats", "evaluate", "evaluation_report", "quality_scores", "semantic_boundaries", "topic_shifts", "window_similarity"),
    "kerf.plugins": ("format_chunks", "formatters", "register_formatter", "register_parser"),
}
_HOME = {name: home for home, names in _HOMES.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"kerf has no {name}")
    return getattr(import_module(_HOME[name]), name)
