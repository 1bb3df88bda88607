"""Functions of the event-listing engine."""
