"""Plans of the travel engine."""
