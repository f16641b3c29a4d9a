"""Column functions: no plan of their own, only expressions."""
