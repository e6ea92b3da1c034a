"""Part of tidemill: sources."""
