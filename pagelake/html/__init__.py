"""HTML trees, selectors and page readers; they run inside the one extraction UDF of a recipe."""
