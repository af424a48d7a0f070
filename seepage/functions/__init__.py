"""Column expressions: text cleaning, mail parsing, pattern extractors."""
