"""Column builders: geometry, tiles, text and pixel arithmetic."""
