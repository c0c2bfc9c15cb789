"""Operators over DataFrames: grounding, scoring, graphs, replay, policy, rules."""
