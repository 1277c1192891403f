"""Operators for preparing training text at scale.

Each module holds one operator with its own general interface; ``queries``
binds them to the test tables, and ``corpus_pipeline.py`` at the repository
top chains five of them.
"""
