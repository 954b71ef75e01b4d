"""Registered queries and larger compositions."""
