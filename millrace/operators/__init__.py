"""Operators: functions from DataFrames and parameters to a DataFrame, with ties broken by ascending ids."""
