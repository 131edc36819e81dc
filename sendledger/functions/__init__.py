"""Column functions: cleaning, dates, labels and predicates."""
