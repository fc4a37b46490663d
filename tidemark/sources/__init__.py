"""Where entries and operations come from, and where they go."""
