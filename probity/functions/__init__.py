"""Scalar functions as Column to Column: text, values, parsing. All run inside the JVM."""
