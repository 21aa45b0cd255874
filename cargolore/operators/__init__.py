"""Composed operators: retrieval, ranking, screening, rules, temporal tables."""
