"""Social-signal and content-feed analytics as Spark DataFrame operators."""
