"""Inputs, generators and stored state."""
