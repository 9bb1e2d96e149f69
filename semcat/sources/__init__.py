"""Reading source trees, reading and writing stored catalogs."""
