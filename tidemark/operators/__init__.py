"""Operators over the domain tables; each takes and returns DataFrames."""
