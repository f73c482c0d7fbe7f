"""Writers of the document engine."""
