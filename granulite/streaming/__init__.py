"""A catalog that grows while it's read."""
