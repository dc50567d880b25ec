"""Operators for preparing training text: filters, joins, models, packing."""
