"""Time-series event studies, cross-sectional analytics and text pipelines on Spark."""
