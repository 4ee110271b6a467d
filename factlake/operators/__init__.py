"""Part of factlake: operators."""
