"""Scalar functions, aggregates and procedures of the query language; each registry is open to users."""
