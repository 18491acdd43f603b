"""Readers with strict schemas."""
