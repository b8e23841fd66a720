"""Streaming application of the operation log."""
