"""Part of tidemill: operators."""
