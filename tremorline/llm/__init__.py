"""Operators for preparing language-model training data: filtering, deduplication, scoring, mixing and packing."""
