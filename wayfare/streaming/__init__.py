"""Streaming of the travel engine."""
