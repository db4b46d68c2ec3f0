"""Column functions: each takes and returns Columns, so that Catalyst sees all of them."""
