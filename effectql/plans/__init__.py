"""Query algebra: tree, entity models, compilers to DataFrames and SQL, front ends."""
