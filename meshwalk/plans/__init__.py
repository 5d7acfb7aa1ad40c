"""Logical plans, front ends and the engine."""
