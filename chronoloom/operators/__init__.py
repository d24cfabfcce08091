"""DataFrame operators over timed events."""
