"""Strataloom operators."""
