"""Column functions: pure expressions over Columns, no actions."""
