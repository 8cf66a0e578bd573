"""Column-level building blocks and scale helpers shared by the operators."""
