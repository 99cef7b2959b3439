"""Operators for preparing large text corpora, with their queries and SQL.

Nothing else in the library imports this subpackage.
"""
