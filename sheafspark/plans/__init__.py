"""Composed runs over the operators."""
