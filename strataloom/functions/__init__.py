"""Strataloom functions."""
