"""Features as Python functions over look-back windows."""
