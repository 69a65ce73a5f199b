"""Scans, aggregates, groups, cursors."""
