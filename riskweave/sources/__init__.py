"""Readers, writers and the registry table."""
