"""Composed plans: the query catalog, experiment grid, ledger, evaluation contract, results."""
