"""Table-to-table derivations."""
