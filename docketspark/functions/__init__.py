"""Column functions: text, dates, numbers and classification ladders, all native."""
