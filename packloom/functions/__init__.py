"""Part of packloom."""
