"""Readers and writers: landing files, layer tables, driver tables."""
