"""Streams into graphs: beyond what the query language covers."""
