"""Tables: schemas, ingest and the tables derived from the test data."""
