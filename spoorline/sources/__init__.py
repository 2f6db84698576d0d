"""Readers and write-once sinks."""
