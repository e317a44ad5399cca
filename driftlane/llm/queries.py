"""Loads every module of this folder that registers a query."""

from __future__ import annotations

from driftlane.llm import base


def load_all():
    from driftlane.llm import bpe, decontaminate, exact, html, licenses, minhash, neighbours, pii, prefix_trie, quality, substrings, toxicity, turn_repair  # noqa: F401

    import corpus_pipeline  # noqa: F401

    return base.QUERIES, base.ORACLES
