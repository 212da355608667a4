"""genoframe: interval, sequence, alignment and variant analytics as lazy Spark DataFrame transformations."""
