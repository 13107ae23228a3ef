"""Column functions. Everything here stays in JVM expressions."""
