"""Sources here are dated files; there is no streaming operator to offer, and none is invented."""
