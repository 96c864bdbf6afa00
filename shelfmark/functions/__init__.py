"""Column-to-Column functions; all stay in the JVM."""
