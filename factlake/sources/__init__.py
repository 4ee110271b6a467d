"""Part of factlake: sources."""
