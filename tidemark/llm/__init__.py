"""Operators for preparing training data: linkage, cleaning, packing and scoring of records and texts."""
