"""spanloom: analytics over corpora of labelled tokens, written for Spark."""
