"""Statements as DataFrame plans: SELECT, INSERT, UPDATE, DELETE."""
