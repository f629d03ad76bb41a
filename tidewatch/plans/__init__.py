"""Plans: several operators together, from readings to stored, featured and grouped events."""
