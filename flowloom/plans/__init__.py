"""Whole jobs: dashboards, training, scoring, explanations."""
