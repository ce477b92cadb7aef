"""Bars from streams."""
