"""Inputs that are derived from the tables, and the registered queries."""
