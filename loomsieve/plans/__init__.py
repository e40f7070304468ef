"""Configuration-driven plans, reports and the command line."""
