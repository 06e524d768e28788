"""Operators for preparing language-model training text.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; the ``opN_*`` queries that apply them to whole tables are in
``queries.py``.
"""
