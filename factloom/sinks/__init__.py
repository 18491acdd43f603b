"""Idempotent writers."""
