"""Training-data operators: scoring, filtering, deduplication, mixing and token output.

Nothing else in the library imports this subpackage; its registered queries and
their SQL live in :mod:`tracequery.llm.queries`.
"""
