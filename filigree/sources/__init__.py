"""Where points come from and where graphs go."""
