"""Operators for training-data pipelines (documents, vectors, urls, tokens).

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
