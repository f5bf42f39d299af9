"""Tables on shared storage and views over the test data."""
