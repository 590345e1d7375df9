"""Part of the fibrion engine."""
