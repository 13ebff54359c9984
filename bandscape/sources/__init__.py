"""Scene catalogues, image and matrix readers, sinks."""
