"""Continuous checks on streams."""
