"""Column functions and small dense linear algebra."""
