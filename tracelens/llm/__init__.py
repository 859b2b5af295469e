"""Operators for large training-data pipelines, one module per operator.

Nothing outside this subpackage imports it.  ``registry`` lists the queries
that apply each operator to its whole table.
"""
