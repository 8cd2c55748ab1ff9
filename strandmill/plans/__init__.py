"""Query compilers: column queries, relational maps and expressions."""
