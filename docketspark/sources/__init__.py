"""Readers of files and of paged or live sources."""
