"""Operators on peak events: DataFrame in, DataFrame out."""
