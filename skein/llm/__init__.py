"""Operators for preparing large text corpora.

Nothing outside this subpackage imports it.  Every module holds one operator with its own
general interface; :mod:`skein.llm.queries` applies each of them to whole tables.
"""
