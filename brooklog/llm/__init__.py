"""Operators for building training data from web-scale text.  Nothing else in the library imports this package."""
