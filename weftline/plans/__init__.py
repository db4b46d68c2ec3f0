"""Programs of several operators."""
