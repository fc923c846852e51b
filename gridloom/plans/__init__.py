"""Plan helpers: durable intermediate tables and session defaults."""
