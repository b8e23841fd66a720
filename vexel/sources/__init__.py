"""Readers and writers for array files, index files, operation logs and page files."""
