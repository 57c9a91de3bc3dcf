"""expirylens: recognised text tokens in, trusted dates and quality reports out, on Spark."""
