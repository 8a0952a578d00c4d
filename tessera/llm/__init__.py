"""Operators for large training-data pipelines: dedup, quality, extraction, packing, mixing and scans.

Nothing outside this subpackage imports it; its queries are in :mod:`tessera.llm.queries`.
"""
