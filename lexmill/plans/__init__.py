"""Query planning on the driver: text queries and their relaxation."""
