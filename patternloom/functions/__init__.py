"""Column expressions that operators share; all run inside the JVM."""
