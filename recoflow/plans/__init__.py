"""Plans: the hybrid recommender and the registered query catalogue."""
