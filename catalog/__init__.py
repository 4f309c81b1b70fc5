"""Registered queries: every operator on the given tables, with its SQL counterpart.

Each module holds ``QUERIES``: name -> (Spark callable, SQL text or None).
"""
