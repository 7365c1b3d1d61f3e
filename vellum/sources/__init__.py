"""Readers of Markdown trees, JSON records and git revisions."""
