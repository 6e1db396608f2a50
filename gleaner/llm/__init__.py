"""Operators for building training corpora: filters, joins, indexes, packing and token counts."""
