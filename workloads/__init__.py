"""Inputs made from the given tables, registered queries and their expected results."""
