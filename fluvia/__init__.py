"""fluvia: a Spark-first analytics engine for river-gauge and rain-gauge networks."""

__version__ = "0.1.0"
