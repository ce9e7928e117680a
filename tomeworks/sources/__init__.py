"""Readers of directory trees, archives and files."""
