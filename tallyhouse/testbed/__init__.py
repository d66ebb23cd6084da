"""Raw retail tables derived from the benchmark tables, and their checks."""
