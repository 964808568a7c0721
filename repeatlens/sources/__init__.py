"""Table loading, declared schemas and sinks."""
