"""Training-data operators: scans, near-duplicate search, scoring and mixing of documents.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames and states in
its docstring what happens to nulls, empty texts, ties, repeated rows and extra columns.
"""
