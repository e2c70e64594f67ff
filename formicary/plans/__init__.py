"""Named queries and the engine that runs them."""
