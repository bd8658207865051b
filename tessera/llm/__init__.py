"""Operators that prepare training data at corpus scale. Nothing else in the library imports this subpackage."""
