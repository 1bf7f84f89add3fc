"""trialframe: Spark DataFrame operators for experiment data and text corpora."""
