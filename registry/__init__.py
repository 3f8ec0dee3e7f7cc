"""The registered queries: library jobs over the star-schema test tables."""
