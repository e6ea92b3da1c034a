"""Part of tidemill: plans."""
