"""Sinks: list, truth and submission writers; model persistence."""
