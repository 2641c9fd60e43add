"""Structured Streaming forms of the ingest, velocity and scoring operators."""
