"""Operators for training-data pipelines: one module per numbered operator, `registry` names their queries."""
