"""Operators on pairs of record streams and on document texts. Nothing else in the library imports this subpackage."""
