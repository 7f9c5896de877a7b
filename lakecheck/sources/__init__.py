"""Readers and writers of the fact tables."""
