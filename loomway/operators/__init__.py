"""Relational and domain operators: functions from DataFrame to DataFrame."""
