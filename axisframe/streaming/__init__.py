"""Array operators on streams."""
