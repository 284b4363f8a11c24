"""Selections, conditions, rules and their findings."""
