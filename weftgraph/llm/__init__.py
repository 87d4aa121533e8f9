"""Training-data operators: one module per operator, plus `queries` for the entry points."""
