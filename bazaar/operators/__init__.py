"""DataFrame -> DataFrame operators of the sales analytics engine."""
