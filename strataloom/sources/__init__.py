"""Strataloom sources."""
