"""Readers and parsers that turn stored text into typed rows."""
