"""Joins, grouped statistics, ordered and stencil operators."""
