"""Strataloom streaming."""
