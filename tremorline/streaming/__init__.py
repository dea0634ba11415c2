"""Keyed streaming state."""
