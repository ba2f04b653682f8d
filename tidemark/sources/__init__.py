"""Where events and schemas come from."""
