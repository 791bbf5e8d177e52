"""Plans: the registered queries, their oracle SQL, and the end-to-end jobs."""
