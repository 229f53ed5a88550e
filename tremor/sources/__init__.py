"""Readers and writers: raw exports, position files, the batch store."""
