"""Empty on purpose: the inventory has no streaming operator."""
