"""Column expressions: geometry, codecs, text, time."""
