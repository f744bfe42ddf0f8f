"""Tables, ontologies and sinks."""
