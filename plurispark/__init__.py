"""Multiverse analytics, output identity and provenance as Spark jobs."""
