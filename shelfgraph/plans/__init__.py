"""Catalogue queries, each in a one-key form and a form for all keys at once."""
