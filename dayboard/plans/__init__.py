"""Plans of the event-listing engine."""
