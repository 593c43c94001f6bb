"""Structured Streaming editions of the operators that keep state."""
