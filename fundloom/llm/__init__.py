"""Operators for preparing language-model training data, on Spark DataFrames.

Nothing outside this package imports it; ``fundloom.llm.queries`` registers
its queries.
"""
