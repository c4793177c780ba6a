"""Functions that build Column expressions."""
