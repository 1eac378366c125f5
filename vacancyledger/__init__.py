"""Job-postings analytics on Spark: extraction, normalisation, lifecycle, matching, feed."""
