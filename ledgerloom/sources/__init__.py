"""Reading from and writing to tables and files."""
