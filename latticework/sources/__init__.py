"""Readers, writers and snapshot storage."""
