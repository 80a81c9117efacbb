"""Plans built of several operators, and the catalogue of queries."""
