"""Column expressions shared by operators and reports; all run inside the JVM."""
