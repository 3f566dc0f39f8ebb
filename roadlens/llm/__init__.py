"""Operators for preparing large text corpora: one module per operator, plus shared helpers.

Nothing outside this subpackage imports it.  ``roadlens.llm.registry`` lists the queries.
"""
