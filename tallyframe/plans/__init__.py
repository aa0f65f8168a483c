"""Plan shapes shared by operators, and the dashboard."""
