"""Readers: files in, DataFrames out."""
