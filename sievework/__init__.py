"""sievework: evaluation analytics, record shredding and de-identification on Spark."""
