"""Strandline streaming."""
