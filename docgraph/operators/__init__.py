"""Operators over collections and graphs; every one takes and returns DataFrames."""
