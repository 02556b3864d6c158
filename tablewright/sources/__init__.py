"""Readers, discovery, sinks and run history."""
