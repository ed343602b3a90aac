"""Readers and writers: sensor registry, chip files, embedding tables, points."""
