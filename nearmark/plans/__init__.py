"""Whole evaluations, and the queries registered for checking."""
