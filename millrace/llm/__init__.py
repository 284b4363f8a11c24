"""Operators for cleaning and mixing large text corpora.

Nothing else in the library imports this subpackage; it can be deleted as a
whole together with ``tests/llm`` and ``corpus_pipeline.py``.
"""
