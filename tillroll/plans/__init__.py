"""End-to-end plans: the customer-value pipeline, the query registry and the
SQL oracles used to verify it."""
