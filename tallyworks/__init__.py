"""Statistical jobs and corpus jobs written as Spark DataFrame operators."""
