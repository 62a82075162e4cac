"""Quirefold functions."""
