"""Operators over units, modifiers and whole quantities."""
