"""Writes: silver, gold, quarantine, reports, metric lines, message frames."""
