"""Operators that turn transcript documents into training text; nothing else in the library imports them."""
