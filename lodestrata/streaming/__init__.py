"""Work on streams: an extension, since inputs of the formats are whole files."""
