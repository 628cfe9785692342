"""Operators chained into the runs a planner starts."""
