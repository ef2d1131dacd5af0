"""riskloom: cohort derivation and risk-score evaluation as Spark DataFrame operators."""
