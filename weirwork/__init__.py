"""weirwork: a Spark-first engine for catalogue audits, search and corpus preparation."""
