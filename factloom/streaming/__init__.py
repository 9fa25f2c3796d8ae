"""Slices that arrive over time."""
