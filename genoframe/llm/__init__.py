"""Operators for large training-data pipelines: ten document, page and dialogue operators.

Nothing outside this subpackage imports it.  Each module holds one operator with a general
interface; :mod:`genoframe.llm.queries` binds them to the shared tables.
"""
