"""Readers and writers of pair tables, dictionaries, metrics and models."""
