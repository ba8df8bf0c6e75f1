"""Operators that prepare text for training: every one takes and gives DataFrames."""
