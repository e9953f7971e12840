"""Security-log analytics as DataFrame -> DataFrame operators on Spark."""
