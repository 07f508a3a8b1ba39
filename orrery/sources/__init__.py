"""Readers and writers of payloads, raw stores and published tables."""
