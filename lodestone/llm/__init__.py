"""Training-data operators: near-duplicate joins, filters, scoring, counting, mixing.

Nothing outside this subpackage imports it, so the folder can be removed without
touching the retrieval engine.
"""
