"""Algebra of relations over bindings and position ranges."""
