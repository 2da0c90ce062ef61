"""Change feeds and views that follow them."""
