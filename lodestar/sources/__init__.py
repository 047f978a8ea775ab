"""Readers, writers and the tables kept on shared storage."""
