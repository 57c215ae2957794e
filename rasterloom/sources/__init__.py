"""Readers, sinks and the relations the queries start from."""
