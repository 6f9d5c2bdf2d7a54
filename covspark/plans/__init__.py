"""Whole analyses: from text or telemetry to findings, coverage, verified claims and deltas."""
