"""Column expressions: text in, value out, all inside the JVM."""
