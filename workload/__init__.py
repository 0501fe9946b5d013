"""Queries over the test tables: adapters, Spark queries and their SQL twins."""
