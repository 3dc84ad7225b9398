"""Scans, parsers, sinks and the domain views derived from the base tables."""
