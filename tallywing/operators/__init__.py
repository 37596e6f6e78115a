"""Analyses over the six tables; each takes a Warehouse or a DataFrame."""
