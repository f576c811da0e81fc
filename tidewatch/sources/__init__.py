"""Scans: raw flow records, source-hour rows, and adapters that view other tables as flows."""
