"""The driver tables shaped as programme tables, and the queries run on them."""
