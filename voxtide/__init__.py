"""Speech-timeline and transcript analytics on Spark tables and streams."""
