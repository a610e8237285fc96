"""Column functions: text, time, codes and identifiers. All stay inside the JVM."""
