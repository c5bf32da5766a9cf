"""Streaming of velora."""
