"""Plans that combine operators, and the catalogue of example queries."""
