"""Readers and typed views of raw market files and tables."""
