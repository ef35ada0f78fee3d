"""Operators on text corpora and vectors for training data. Nothing outside this subpackage imports it."""
