"""Recorded computations, chains of tools, and the planner with its privacy gate and citation check."""
