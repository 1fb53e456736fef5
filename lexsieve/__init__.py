"""lexsieve: text moderation and corpus operators expressed on Spark DataFrames."""
