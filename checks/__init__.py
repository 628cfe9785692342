"""Registered queries: every operator over the whole test tables, with the SQL it is compared to."""
