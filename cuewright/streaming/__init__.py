"""Operators on the status-event log, as streams."""
