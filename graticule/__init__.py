"""graticule: manifold analytics, graph and statistics operators over keyed Spark DataFrames."""
