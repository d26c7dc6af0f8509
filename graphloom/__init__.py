"""graphloom: code-graph analytics as Spark DataFrame operators."""
