"""Operators for training-data pipelines.

Nothing outside this package imports it.  ``QUERIES`` and ``SQL`` in
:mod:`quarryline.llm.catalogue` list its queries and the SQL of those that SQL can express.
"""
