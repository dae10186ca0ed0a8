"""Readers, writers and small lookup relations."""
