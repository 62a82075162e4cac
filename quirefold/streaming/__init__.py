"""Quirefold streaming."""
