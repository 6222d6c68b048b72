"""Sources and sinks: file formats, stores, encoders."""
