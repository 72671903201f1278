"""Column expressions; each takes and gives Columns, so Catalyst sees through them."""
