"""Operators for preparing training data at scale (see README, "Training-data operators").

Nothing outside this package imports it; ``queries`` registers its queries.
"""
