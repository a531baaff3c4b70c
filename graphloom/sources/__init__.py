"""What graphs are read from and written to."""
