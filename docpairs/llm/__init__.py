"""Operators of a large-scale training-data pipeline.

One module per operator; ``queries.py`` registers one query for each. Nothing outside
this subpackage imports it.
"""
