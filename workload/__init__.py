"""Registered queries: the operators applied to the star-schema test tables, with oracle SQL."""
