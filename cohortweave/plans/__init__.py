"""Operators chained into the whole jobs: cohort build, simplification, sample input."""
