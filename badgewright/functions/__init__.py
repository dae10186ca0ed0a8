"""Column builders. Every function returns a Spark ``Column`` expression."""
