"""Operators for preparing language-model training text, each a function from DataFrame to DataFrame."""
