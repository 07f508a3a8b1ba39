"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; its queries and oracle SQL are in
``orrery.llm.queries``.
"""
