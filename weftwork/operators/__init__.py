"""Operators over translation tables, one module for each family."""
