"""Operators for preparing training text and code. Nothing outside imports this."""
