"""Operators for building training corpora: tokens, duplicates, decontamination, quality, PII, scoring.

Nothing else in the library imports this subpackage; its queries are in
:mod:`tabtaint.llm.queries` and its pipeline in ``corpus_pipeline.py``.
"""
