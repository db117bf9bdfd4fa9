"""Operators of the travel engine."""
