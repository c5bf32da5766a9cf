"""Operators of velora."""
