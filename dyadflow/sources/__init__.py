"""Readers and input contracts."""
