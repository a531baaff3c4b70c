"""The property graph and what reads it: scans, expansions, exploration, search."""
