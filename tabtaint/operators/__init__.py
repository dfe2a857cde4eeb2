"""DataFrame operators: sampling, splitting, corruption, cleaning, profiles, generators, evaluators."""
