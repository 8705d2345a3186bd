"""Lorewright: long-form narrative analytics expressed on Spark DataFrames."""
