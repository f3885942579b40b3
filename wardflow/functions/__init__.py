"""Column expressions: Column in, Column out, all inside the JVM."""
