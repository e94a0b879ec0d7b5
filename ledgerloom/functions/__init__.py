"""Column functions: money, dates, text and row identity. All are native expressions."""
