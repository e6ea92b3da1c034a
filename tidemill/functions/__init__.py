"""Part of tidemill: functions."""
