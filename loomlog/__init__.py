"""Conversation-log analytics on Spark DataFrames."""
