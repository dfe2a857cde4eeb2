"""Column-level functions: seeded hash randomness, string typos, id codecs, encoders, metrics."""
