"""Daily gas-flow analytics written as Spark DataFrame transformations."""
