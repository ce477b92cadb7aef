"""Operators of a large training-data pipeline: counting, archiving, mixing, de-duplicating and scoring text.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports this subpackage.
"""
