"""Reading and writing tables, and the fixtures of the queries."""
