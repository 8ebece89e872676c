"""Scenes from streams of pair scores."""

from .scenes import stream_cuts

__all__ = ["stream_cuts"]
