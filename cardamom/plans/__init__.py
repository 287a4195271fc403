"""Shapes of plans that several operators share."""
