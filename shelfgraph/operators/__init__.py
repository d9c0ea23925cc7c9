"""Reusable DataFrame operators: expands, ranking, closure, embedding, neighbours."""
