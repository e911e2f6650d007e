"""serieslab: feature engineering, selection and evaluation of time series as Spark DataFrame operations."""
