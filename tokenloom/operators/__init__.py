"""Operators: functions from DataFrames to DataFrames; nothing is collected before a sink unless it says so."""
