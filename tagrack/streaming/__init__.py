"""Structured Streaming operators and their availableNow runners."""
