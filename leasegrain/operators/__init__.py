"""Operators: functions from DataFrames to a DataFrame, without actions."""
