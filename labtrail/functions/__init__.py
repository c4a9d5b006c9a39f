"""Column builders: no function here triggers a job or moves rows."""
