"""Continuous versions of status, play-count, horizon and manifest operators."""
