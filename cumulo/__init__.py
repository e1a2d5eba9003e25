"""cumulo: point-cloud analytics and corpus operators written as Spark DataFrame jobs."""
