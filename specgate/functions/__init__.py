"""Column expressions shared by the operators; everything stays on the JVM side."""
