"""Column expressions: text cleaning, lengths, labels and rounding."""
