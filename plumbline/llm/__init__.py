"""Operators for preparing training text, each over whole tables and whole texts."""
