"""Column expressions and fixed vocabularies shared by the operators."""
