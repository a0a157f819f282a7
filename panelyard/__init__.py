"""Panel features, projection scoring, forecast evaluation and decision tables as Spark DataFrame operators."""
