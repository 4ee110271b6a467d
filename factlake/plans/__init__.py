"""Part of factlake: plans."""
