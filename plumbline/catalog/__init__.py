"""Queries that bind the operators to the driver's tables, each with its SQL counterpart."""
