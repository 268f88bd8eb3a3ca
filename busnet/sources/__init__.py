"""Readers that yield the feature tables every derivation starts from."""
