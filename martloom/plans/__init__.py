"""Chains of operators and whole jobs built from them."""
