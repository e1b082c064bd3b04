"""Named reports and the wiring of every registered query."""
