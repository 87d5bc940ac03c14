"""Dry-run plans (tables of decisions) and the jobs that apply them."""
