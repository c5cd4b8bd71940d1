"""Sources and sinks: table readers, adapters, cell grids, column mapping, stores."""
