"""Operators for large text corpora: tokens, markup, language, archives, secrets, quality, copies and leaks.

Nothing outside this subpackage and ``corpus_pipeline.py`` imports it.
"""
