"""Streaming side of the engine."""
