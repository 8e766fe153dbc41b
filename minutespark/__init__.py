"""minutespark: meeting-minutes analytics and retrieval as Spark plans."""
