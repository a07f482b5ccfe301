"""Relational and stateful operators over canonical trajectory tables."""
