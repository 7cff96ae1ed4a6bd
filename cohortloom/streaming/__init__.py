"""Structured Streaming delivery of the same expressions the batch jobs use."""
