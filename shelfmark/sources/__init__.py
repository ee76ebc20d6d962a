"""Readers and writers for folders, zip archives and audio containers."""
