"""Part of verbaspark."""
