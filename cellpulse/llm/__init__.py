"""Operators that prepare text corpora for language-model training.

Each module holds one operator with a general interface; ``queries`` applies them to the test tables.
Nothing outside this subpackage imports it, except ``corpus_pipeline.py`` and the guard in ``__spark_entry__.py``.
"""
