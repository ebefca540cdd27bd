"""Event-time windows and scoring that run alike on batches and on streams."""
