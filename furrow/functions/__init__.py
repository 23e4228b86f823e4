"""Column functions: every helper maps Columns to a Column and stays in the JVM."""
