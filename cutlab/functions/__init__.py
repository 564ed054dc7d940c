"""Column functions: vectors, names and formats. All stay in the JVM."""
