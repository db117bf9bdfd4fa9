"""Functions of the travel engine."""
