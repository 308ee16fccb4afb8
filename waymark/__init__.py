"""Analytics on Spark for catalogues built from semi-structured sources."""
