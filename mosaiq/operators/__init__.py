"""Matrix operators: multiplication, solves, factorizations, inverses, eigensolvers, norms, permutations."""
