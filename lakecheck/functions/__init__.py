"""Column expressions; none of them leaves the JVM."""
