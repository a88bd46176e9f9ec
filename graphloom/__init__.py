"""graphloom: a property-graph, ontology and event-journal engine on Spark DataFrames."""
