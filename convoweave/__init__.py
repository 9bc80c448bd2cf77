"""convoweave: conversation-memory analytics written as Spark DataFrame jobs."""
