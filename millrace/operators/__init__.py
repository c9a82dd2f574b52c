"""Relational operators as DataFrame compositions."""
