"""Training-data operators: text extraction, counting, deduplication, placement.

Nothing outside this subpackage imports it; the registry in ``llm.queries``
exposes the operators as queries and holds their SQL.
"""
