"""Quirefold operators."""
