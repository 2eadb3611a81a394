"""Readers and writers: scored CSV tables, feature store, quarantine, result files."""
