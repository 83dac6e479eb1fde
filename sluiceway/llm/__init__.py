"""Operators for training-data collections. Nothing outside this subpackage imports it."""
