"""Column functions: text, numbers, dates, shapes, equality, conversion."""
