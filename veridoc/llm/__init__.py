"""Operators for building large text corpora. Nothing outside this package imports it."""
