"""Operators on text and token sequences for training data. Nothing outside this subpackage imports it."""
