"""Column functions: text, numbers, units and business rules."""
