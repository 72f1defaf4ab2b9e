"""Column expressions: predicates, typed encoding, reducers."""
