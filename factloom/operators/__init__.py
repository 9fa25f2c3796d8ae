"""Operators over facts, graphs, cases and vectors; all but the solvers are plain DataFrame plans."""
