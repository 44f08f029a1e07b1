"""Deductive analytics on Spark: facts and rules as DataFrame plans, with complete answers or an error."""
