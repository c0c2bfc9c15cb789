"""Tables and files: bundles, stores, review files, CSV and JSON sources."""
