"""Whole plans: the gate from changes to a score, and change sets derived from tables."""
