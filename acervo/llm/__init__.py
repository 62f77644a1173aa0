"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its general interface; :mod:`acervo.llm.queries` derives the
registered ``opN_<name>`` queries from them.
"""
