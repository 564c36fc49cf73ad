"""Supply-chain and marketplace-seller analytics as plain Spark DataFrame functions."""
