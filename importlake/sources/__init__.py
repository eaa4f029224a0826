"""Scans, cleaning of files, sinks and table maintenance."""
