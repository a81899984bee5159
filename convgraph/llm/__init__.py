"""Operators for preparing training text: scoring, filtering, near copies, mixing and packing."""
