"""Structured Streaming jobs: motion readings and the session log."""
