"""Strandline plans."""
