"""Part of factlake: streaming."""
