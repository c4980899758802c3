"""Sources and sinks: images, configuration, vocabularies, bindings of the driver tables."""
