"""Community-profile, measurement and graph analytics as Spark DataFrame operators."""
