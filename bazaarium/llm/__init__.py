"""Operators for preparing training text: each module holds one operator that works on Spark DataFrames.

Nothing outside this subpackage imports it.  ``queries`` registers one query per operator.
"""
