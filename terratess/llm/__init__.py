"""Training-data operators: one module per operator, SQL and queries beside them."""
