"""Decisions and compositions: cleaning plans, recipes, scoring, selection."""
