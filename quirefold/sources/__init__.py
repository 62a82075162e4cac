"""Quirefold sources."""
