"""Column expressions: numbers, fuzzy weights, decay, beliefs, vectors, memories, codecs."""
