"""Relational operators of the flow analytics engine."""
