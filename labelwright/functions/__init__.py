"""Column-to-Column building blocks: every function here stays inside the JVM."""
