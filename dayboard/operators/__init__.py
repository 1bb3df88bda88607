"""Operators of the event-listing engine."""
