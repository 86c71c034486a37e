"""Readers, writers and the append-only stores."""
