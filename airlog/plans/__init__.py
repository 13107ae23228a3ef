"""Playout plans: timelines, segments and break plans, one row per plan entry."""
