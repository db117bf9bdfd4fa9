"""Sinks of the travel engine."""
