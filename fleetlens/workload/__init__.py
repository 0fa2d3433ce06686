"""The operators run over the given tables: adapters, queries and their SQL counterparts."""
