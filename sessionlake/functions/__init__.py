"""Column-level functions (no shuffles, all inside codegen)."""
