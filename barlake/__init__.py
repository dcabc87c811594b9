"""Market-research analytics as DataFrame operators on Spark."""
