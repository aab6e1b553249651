"""Operators on text and records for training data; nothing outside this package imports it."""
