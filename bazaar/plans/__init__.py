"""Jobs, the query catalog and the SQL oracle."""
