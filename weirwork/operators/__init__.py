"""Catalogue and document operators over DataFrames."""
