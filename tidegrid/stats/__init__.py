"""Hypothesis tests over long tables ``(block, grp, v)``.

Every pass over the data is an aggregate with map-side partials; only tables of
one row per group, or one row per comparison, reach the p-value functions.
"""
