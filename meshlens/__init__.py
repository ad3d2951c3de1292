"""meshlens: PySpark analytics over service-architecture graphs."""
