"""DataFrame operators: row order, concatenation, packing, vocabulary, scoring."""
