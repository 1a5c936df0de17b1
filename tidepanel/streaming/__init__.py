"""Structured Streaming: windows, idempotent sinks, late rows and maturing records."""
