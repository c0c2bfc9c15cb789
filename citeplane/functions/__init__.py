"""Column functions: ids, text, spans, statistics."""
