"""Continuous ingest and maintenance by Structured Streaming."""

from nearfield.streaming.ingest import maintain_stream, put_stream

__all__ = ["maintain_stream", "put_stream"]
