"""Event-sequence, tabular and frame analytics written as Spark DataFrame operators."""
