"""Sources and sinks: fact bindings, staging/CSV readers, summary writers."""
