"""Structured Streaming form of the audit."""
