"""Whole jobs: from input tables to the results a user asks for."""
