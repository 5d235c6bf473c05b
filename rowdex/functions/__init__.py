"""Pure functions: seeded orders, sampler draws, collation."""
