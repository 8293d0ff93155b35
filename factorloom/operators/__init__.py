"""Relational operators, training, prediction and the parameter server."""
