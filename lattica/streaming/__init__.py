"""Changes as events: triggers, a change log, and windows over event tables."""
