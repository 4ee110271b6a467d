"""Part of factlake: functions."""
