"""Operators for preparing training text: documents in, decisions out. Nothing else in the package imports this."""
