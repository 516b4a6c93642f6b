"""Plans: adapter views over the driver's tables, the registered queries and the jobs."""
