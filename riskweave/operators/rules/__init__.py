"""Typology rules evaluated once per wallet as column expressions."""
