"""Operators of corpus distillation; each takes and returns DataFrames."""
