"""A PySpark engine that matches security advisories against asset inventories."""
