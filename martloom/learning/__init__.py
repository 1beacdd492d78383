"""Training, validation, tuning, selection and scoring on pyspark.ml."""
