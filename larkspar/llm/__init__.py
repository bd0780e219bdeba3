"""Operators for preparing training text: one module per operator, on Spark DataFrames.

Nothing outside this subpackage imports it.  Each module holds a general operator (a function on
DataFrames) and a thin ``opN_...`` query that reads the given tables and applies the operator with
production parameters.
"""
