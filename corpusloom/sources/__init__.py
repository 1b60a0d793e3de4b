"""Reading and writing chat records and their companions."""
