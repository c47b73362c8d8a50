"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  One module per operator;
``registry`` holds the driver queries and their SQL.
"""
