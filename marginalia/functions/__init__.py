"""Functions of the annotation engine."""
