"""Query shapes shared by several operators, and the workflow runner."""
