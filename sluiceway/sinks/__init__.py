"""Writers: batch directories, upserted tables, queues, topics."""
