"""Bars and where they come from."""
