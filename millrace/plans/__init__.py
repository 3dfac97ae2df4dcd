"""The registered queries: operators applied to the given tables, and the same in SQL."""
