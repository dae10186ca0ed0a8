"""Facts (cubes) and the reports computed from them."""
