"""Registries of scalar, aggregate and analytic functions."""
