"""Query specifications, validation, coverage, fan-out and reconciliation."""
