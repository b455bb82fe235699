"""Structured Streaming form of the late-file ingest."""
