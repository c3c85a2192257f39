"""Operators of a large-scale training-data pipeline.

Nothing else in the package imports this subpackage; ``queries`` holds the
registered queries and their SQL.
"""
