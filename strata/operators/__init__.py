"""DataFrame operators: change capture, quality, metrics, star schema, control."""
