"""Operators for preparing language-model training data, each over whole tables of any size."""
