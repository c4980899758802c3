"""Chains of operators, and the registry of translation engines."""
