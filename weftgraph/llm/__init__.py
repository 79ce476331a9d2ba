"""Training-data operators: one module per operator, no imports from here by the rest of the library."""
