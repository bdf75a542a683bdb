"""Column -> Column functions: Python string semantics (strip, split, capitalize, digits,
whitespace) and word-bounded spans / token positions, all as JVM-side expressions."""
