"""Readers: scripts, telemetry, rules, saved runs."""
