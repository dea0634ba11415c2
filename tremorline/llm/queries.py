"""Imports every operator module, which registers its query."""

from tremorline.llm import (
    divergence,
    embeddings,
    importance,
    language_model,
    licenses,
    mixing,
    near_text,
    packing,
    private_data,
    repeated_spans,
    token_files,
    toxicity,
    winnowing,
)
from tremorline.llm.registry import CHECKS, QUERIES

__all__ = [
    "CHECKS",
    "QUERIES",
    "divergence",
    "embeddings",
    "importance",
    "language_model",
    "licenses",
    "mixing",
    "near_text",
    "packing",
    "private_data",
    "repeated_spans",
    "token_files",
    "toxicity",
    "winnowing",
]
