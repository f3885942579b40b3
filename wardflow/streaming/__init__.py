"""Structured Streaming: event decoding, per-minute counts and department state."""
