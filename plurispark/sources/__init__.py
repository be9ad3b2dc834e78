"""Readers and writers for what the engine's tools leave on disk."""
