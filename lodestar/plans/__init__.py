"""Physical building blocks (grid joins, ordinals, carry-forward) and whole jobs."""
