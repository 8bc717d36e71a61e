"""Document screening, evidence scoring and gap analysis as Spark DataFrame operators."""
