"""Operators: functions from DataFrames to DataFrames. None of them collects data rows."""
