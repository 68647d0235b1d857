"""Evidence retrieval over versioned text corpora, planned by Spark."""
