"""SQL that states each query's expected answer for an independent engine."""
