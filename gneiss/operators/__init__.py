"""DataFrame operators that queries and plans are made of."""
