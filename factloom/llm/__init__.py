"""Training-data operators: extraction, filtering, deduplication, mixing and tokenisation.

Nothing outside this subpackage imports it; the queries over it are in ``queries``.
"""
