"""Readers and writers: delimited text, edge lists, column files."""
