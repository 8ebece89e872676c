"""Operators on frames, blocks and scores."""
