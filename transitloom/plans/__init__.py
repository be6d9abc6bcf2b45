"""Plan-level helpers: staging tables and iterative plans."""
