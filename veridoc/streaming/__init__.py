"""Streams of new files and of events."""
