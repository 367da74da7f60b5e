"""Relational, mining and ordered-data operators; DataFrame in, DataFrame out."""
