"""Whole plans made of operators, and the registered queries."""
