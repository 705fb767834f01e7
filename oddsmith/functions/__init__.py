"""Column builders over ragged vectors; all stay inside the JVM."""
