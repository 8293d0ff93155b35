"""Expressions and plain functions."""
