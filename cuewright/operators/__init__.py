"""Operators on cue, segment and status tables."""
