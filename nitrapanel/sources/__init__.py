"""Readers, landing, table resolution and sinks."""
