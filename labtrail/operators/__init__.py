"""DataFrame operators for cleaning, cohorts and features."""
