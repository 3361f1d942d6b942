"""Readers, writers and schema decisions."""
