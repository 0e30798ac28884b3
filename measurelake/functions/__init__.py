"""Column expressions: lexicon, text predicates and normalization, numbers, formatting."""
