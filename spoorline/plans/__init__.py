"""Whole flows over the operators, and the catalogue of registered queries."""
