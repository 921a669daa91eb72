"""Registry, job plans and the queries of the driver contract."""
