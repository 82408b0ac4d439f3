"""Column functions: geometry, draws, predicates and small parsers."""
