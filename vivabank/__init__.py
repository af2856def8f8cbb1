"""vivabank: question-bank, assessment-session and scorer analytics as Spark DataFrame jobs."""
