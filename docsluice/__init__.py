"""Document-intelligence table and stream jobs on Spark."""
