"""Part of tidemill: streaming."""
