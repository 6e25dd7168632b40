"""Reading and writing collections."""
