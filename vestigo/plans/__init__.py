"""Queries over the supplied tables, each with its SQL twin where SQL can express it."""
