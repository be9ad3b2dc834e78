"""Streams of changes, task events and results, each with its batch twin."""
