"""Strataloom plans."""
