"""Operators for preparing language-model training corpora.

Nothing outside this package imports it; the queries are listed in
``loamline.llm.queries`` and registered only when this package is present.
"""
