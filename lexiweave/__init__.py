"""lexiweave: document analytics and batch translation on Spark."""
