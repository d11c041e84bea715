"""Operators that need more than one built-in of Spark."""
