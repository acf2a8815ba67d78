"""Reusable DataFrame operators: lookups, rate selection, shares, scaling, filters."""
