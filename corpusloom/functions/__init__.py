"""Column expressions for normalising and tokenising text."""
