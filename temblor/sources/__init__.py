"""Readers and writers of event catalogs."""
