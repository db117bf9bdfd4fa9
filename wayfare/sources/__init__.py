"""Sources of the travel engine."""
