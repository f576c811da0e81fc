"""Relational operators: reduction, profiles, campaigns, synchrony tests, lineage, reports, scores."""
