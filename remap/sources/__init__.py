"""Readers and writers: registry CSV, run-log XML, catalog text, JSON notes, copies."""
