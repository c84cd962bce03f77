"""annoweave: annotated corpora and training-data preparation on Apache Spark."""
