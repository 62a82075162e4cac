"""Quirefold plans."""
