"""turnloom: conversation-corpus and character-model analytics on Spark DataFrames."""
