"""patternlake: experience-pattern analytics and retrieval on PySpark."""
