"""Training-data operators: each works on a documents-like table and stays partitioned throughout."""
