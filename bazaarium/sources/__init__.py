"""Readers of captured payloads, and sinks."""
