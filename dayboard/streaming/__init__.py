"""Streaming of the event-listing engine."""
