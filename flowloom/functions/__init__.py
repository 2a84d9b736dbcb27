"""Column expressions: no job runs here and nothing leaves the JVM unless a docstring says so."""
