"""Sinks: tables, text formats and logs that other programs read."""
