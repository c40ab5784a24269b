"""Operators over panels, factor values and screening statistics."""
