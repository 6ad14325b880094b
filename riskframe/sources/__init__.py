"""Schemas, readers, writers and adapters."""
