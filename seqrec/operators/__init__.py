"""Relational and learning operators over interaction sequences."""
