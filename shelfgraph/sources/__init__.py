"""Graph tables: schemas, readers, writers, checks."""
