"""Expressions: scalar functions, arithmetic, predicates and aggregates."""
