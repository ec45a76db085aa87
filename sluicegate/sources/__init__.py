"""Readers of the file formats, files and raw segments."""
