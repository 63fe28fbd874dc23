"""Training-data operators: deduplication, filtering, scoring, formatting,
archives and mixing over text tables. Nothing else in the library imports
this subpackage."""
