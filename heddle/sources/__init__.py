"""Readers, writers and text codecs."""
