"""citeplane: evidence-grounded text analytics as Spark DataFrame operators."""
