"""Readers and writers for the canonical tables, reports and logs."""
