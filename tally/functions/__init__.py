"""Column functions and period algebra."""
