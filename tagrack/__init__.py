"""tagrack: catalogue analytics on Spark (see README.md)."""
