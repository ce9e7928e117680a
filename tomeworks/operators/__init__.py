"""Operators on corpora: DataFrames of (rel_path, content) rows."""
