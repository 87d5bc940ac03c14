"""Writers: snapshots, native JSONL, audit log."""
