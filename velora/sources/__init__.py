"""Sources of velora."""
