"""Relational operators over selections."""
