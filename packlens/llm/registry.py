"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from packlens.llm import q_align, q_bpe, q_decontaminate, q_langid, q_mixing, q_neardup, q_pii, q_quality, q_render, q_repeats, q_topk, q_trie, q_warc

_MODULES = (q_align, q_bpe, q_decontaminate, q_langid, q_mixing, q_neardup, q_pii, q_quality, q_render, q_repeats, q_topk, q_trie, q_warc)


def all_queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
