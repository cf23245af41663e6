"""Spark-first engine for evaluating, auditing and preparing document-question corpora.

Importing the package starts nothing: the names below are resolved when they are first used.
"""

from __future__ import annotations

import importlib

#: Public names and the modules they come from.
_PLACES = {
    "quillframe.session": ("get_session", "table", "ship", "cut"),
    "quillframe.operators.rules": ("Rule", "GateError", "violations", "gate", "coverage", "duplicates"),
    "quillframe.operators.evaluate": ("agreement", "fidelity", "compared", "micro_error", "block_aligned", "instance_scores", "scorecard", "portal", "latency"),
    "quillframe.operators.blocks": ("rebuilt_blocks", "without_artifacts", "engine_lines", "output_reason", "snippets"),
    "quillframe.operators.plan": ("shards", "held_out", "batches", "pending", "latest", "unanimous", "route", "limited", "retried"),
    "quillframe.operators.merge": ("merge_violations", "expanded_reviews", "review_shard_violations", "overlaid", "alignment", "risk"),
    "quillframe.operators.screen": ("signals", "tags", "severity", "computed_answer"),
    "quillframe.sources.jsonl": ("numbered_lines", "strict_violations", "lenient", "hashed_files", "png_sizes"),
    "quillframe.sources.sinks": ("label_free", "write_json_lines", "write_shards", "publish", "publish_pair", "bundle", "managed", "environment"),
    "quillframe.streaming.ingest": ("ingest", "current"),
}
_HOME = {name: module for module, names in _PLACES.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module 'quillframe' has no attribute {name!r}")
    return getattr(importlib.import_module(_HOME[name]), name)
