"""Surfaces, pairing, rules, findings and scores as DataFrame transformations."""
