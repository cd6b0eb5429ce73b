"""lanternfish: site-audit analytics and corpus preparation as Spark DataFrame jobs."""
