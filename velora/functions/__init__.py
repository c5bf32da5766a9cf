"""Functions of velora."""
