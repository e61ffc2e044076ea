"""Structured Streaming forms, an extension: the batch operators need none."""
