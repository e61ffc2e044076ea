"""tidemark: measurement and evaluation of space-time tables on Spark."""
