"""Reports, feature tables, models, quality checks and table updates."""
