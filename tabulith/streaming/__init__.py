"""Statistical files as streams."""
