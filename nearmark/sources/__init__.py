"""Readers, writers and generators of vector tables."""
