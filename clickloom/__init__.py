"""clickloom: click-log analytics as Spark DataFrame operators."""
