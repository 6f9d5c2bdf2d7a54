"""Structured Streaming: the same operators over telemetry as it arrives."""
