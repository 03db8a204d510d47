"""textquarry: text search, code intelligence and usage analytics as Spark plans."""
