"""Structured Streaming jobs with the semantics of the batch operators."""
