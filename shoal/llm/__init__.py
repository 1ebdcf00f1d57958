"""Operators for preparing large training corpora (deduplication, filtering, scoring, packing).

Nothing outside this subpackage imports it; its queries live in ``shoal.llm.queries``.
"""
