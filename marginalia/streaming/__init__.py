"""Streaming of the annotation engine."""
