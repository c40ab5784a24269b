"""Keeping panels up to date from streams."""
