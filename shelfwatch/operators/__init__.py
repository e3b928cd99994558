"""Distributed building blocks: series usage, tails, criticality, diffs, quality."""
