"""wareloom: product-catalog jobs for Spark."""
