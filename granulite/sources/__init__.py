"""Where granules come from: the catalog of files, and drivers that yield their chunks."""
