"""corpusloom: Spark operators that curate, split, profile and score
question-to-SQL chat corpora."""
