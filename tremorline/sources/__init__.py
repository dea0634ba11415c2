"""Readers of stores, traces and buffers."""
