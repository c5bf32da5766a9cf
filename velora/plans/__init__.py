"""Plans of velora."""
