"""Column functions: vectors and texts, all inside the JVM."""
