"""Readers: directories, batches, queues, sidecar schemas, dataflow documents."""
