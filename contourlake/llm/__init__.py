"""Operators for preparing language-model training data.

Nothing outside this package imports it; :mod:`contourlake.llm.registry` lists its queries and their SQL.
"""
