"""Subpackage queries."""
