"""From query text to a checked syntax tree."""
